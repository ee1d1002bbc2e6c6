import random
import re
from collections import Counter

from newsloom.llm.pii import KINDS, base_spans, candidates, find, fit, luhn, redact, redacted_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def check(docs):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in find(docs).collect()), key=key)
    assert got == sorted(((r["doc_id"], plain(r["text"])) for r in docs.collect()), key=key)


def test_documents(small):
    check(small)


def test_odd_rows(odd, empty):
    check(odd)
    assert find(empty).count() == 0 and redacted_documents(empty).count() == 0


def test_base_spans_of_random_text():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a1@.-+ %(0é2\n9") for _ in range(rng.randint(0, 60)))
        assert base_spans(text) == plain(text), text
        text = " ".join(rng.choice(["4539 1488 0343 6467", "+1 (202) 555-0143", "10.0.0.300", "1.2.3.4.5", "a@b.co@c.de", "x@y", "00000255.1.1.1", "4111-1111-1111-1111", "1" * 30]) for _ in range(6))
        assert base_spans(text) == plain(text), text


def test_votes_decide_on_doubtful_spans():
    good = ["call us: (312) 867-5309 today", "phone 312 867 5309 please", "iban DE89 3704 0044 0532 0130 00 account"]
    bad = ["serial 000 000 0000 item", "model 011-111-1111x"]
    counts = Counter((c.kind, c.votes, c.shape) for t in good * 30 + bad * 30 for c in candidates(t))
    model = fit(counts)
    kinds = [{KINDS[c.kind] for c in candidates(t) if model.accepts(c)} for t in good + bad]
    assert kinds[0] == {"local_phone"} and kinds[2] == {"iban"} and not kinds[3]


def test_redaction(spark):
    model = fit(Counter())
    assert redact("to a.b@c.de or +1 (202) 555-0143.", model) == "to [EMAIL] or [PHONE]."
    assert redact(None, model) is None and redact("", model) == ""
    docs = spark.createDataFrame([(1, "x 10.1.2.3 y", 5), (2, None, 6)], "doc_id long, text string, spans int")
    assert sorted(map(tuple, redacted_documents(docs).collect())) == [(1, "x [IP] y", 5), (2, None, 6)]
