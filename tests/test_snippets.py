"""The best window of a message, by a loop over all candidates."""

import re

from threadloom.functions.query_text import Or, Phrase
from threadloom.operators import fulltext
from threadloom.operators.search_index import Index
from threadloom.plans import registry, views
from threadloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def looped(text, terms, size=64):
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
    words = [text[a:b].lower() for a, b in spans]
    if not words:
        return ""
    at = sorted((i, p, len(t)) for p, t in enumerate(terms) for i in range(len(words)) if tuple(words[i : i + len(t)]) == t)
    begins = [k for k, (a, _) in enumerate(spans) if k == 0 or re.search(r"[.:][ \t\r\n]+$", text[:a])] if len(words) > size else []

    def score(pos):
        inside = [x for x in at if pos <= x[0] < pos + size]
        kinds = len({x[1] for x in inside})
        return kinds * 999 + len(inside), max((x[0] + x[2] for x in inside), default=0)

    best = (-1, 0)
    for off, _, _ in at:
        s, last = score(off)
        centred = max(0, min(off - int((size - (last - off)) / 2), len(words) - size))
        if s > best[0]:
            best = (s, centred)
        before = [b for b in begins if b <= off]
        if before and before[-1] < off:
            s = score(before[-1])[0] + (120 if before[-1] == 0 else 100)
            if s > best[0]:
                best = (s, before[-1])
    lo = best[1]
    hi = min(len(words), lo + size)
    out = "..." if lo else text[: spans[0][0]]
    covers = lambda a, b: any(x[0] <= a and x[0] + x[2] > b for x in at)
    for k in range(lo, hi):
        out += text[spans[k - 1][1] : spans[k][0]] if k > lo else ""
        out += ">>>" if covers(k, k) and (k == lo or not covers(k - 1, k)) else ""
        out += text[spans[k][0] : spans[k][1]]
        out += "<<<" if covers(k, k) and (k == hi - 1 or not covers(k, k + 1)) else ""
    return out + ("..." if hi < len(words) else text[spans[-1][1] :])


TERMS = [("general", "public", "license"), ("the",), ("clown",)]


def test_documents_equal_the_loop(spark):
    texts = {r.message_id: r.message_text for r in views.doc_messages(spark, SF).where("retrieval_class = 'hot'").collect()}
    got = {r.message_id: r.match_snippet for r in registry.fts_snippet_best(spark, SF).collect()}
    # letters that the two regular expressions class alike
    plain = {i for i, t in texts.items() if t is not None and not re.search(r"[^\x00-ɏ‐-‧]", t)}
    wanted = {i: looped(texts[i], TERMS) for i in plain if i in got}
    assert len(wanted) > 20 and {i: got[i] for i in wanted} == wanted
    assert all(i in got for i in plain if ">>>" in looped(texts[i], TERMS) and ">>>" not in texts[i])


def test_made_windows(spark, tmp_path):
    x = " ".join(f"x{i}" for i in range(100))
    texts = {
        "later": f"the {x} {x} the clown {x}",
        "sentence": f"{x} {x}. Here a b c the d {x}",
        "overlap": "aa aa aa bb",
        "short": "The, clown!",
        "edge": f"{x} clown",
        "none": "nothing",
        "empty": "",
        "null": None,
    }
    rows = [(i, "s", n, t, None, n, "user", "hot") for n, (i, t) in enumerate(texts.items())]
    m = spark.createDataFrame(rows, ingest.MESSAGE_SCHEMA)
    index = Index.build(m, f"{tmp_path}/i", stems=False)
    terms = [("the",), ("clown",), ("aa", "aa")]
    plan = Or(tuple(Phrase(t) for t in terms))
    got = {r.message_id: r.match_snippet for r in fulltext.best_snippets(index, m, plan).collect()}
    assert got == {i: looped(t, terms) for i, t in texts.items()}
    assert ">>>the<<< >>>clown<<<" in got["later"] and got["later"].startswith("...")
    assert got["sentence"].startswith("...Here a b c >>>the<<<") and got["overlap"] == ">>>aa aa aa<<< bb"
    assert got["short"] == ">>>The<<<, >>>clown<<<!" and got["none"] == "nothing" and got["null"] == ""
