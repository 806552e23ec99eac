import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from gridpulse.llm import audit

DOCS = "doc_id long, text string, lang string, digest string, n_words string, part string"
LABELS = "doc_id long, quality int, toxic int"


def by_force(docs, labels):
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        letters = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        letters += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        smaller = [j for j, u, _ in docs if (u or "") == t and j is not None and (i is None or j < i)]
        fails.append((lang or "", i, letters + "E" * bool(smaller)))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for _, f in own:
                if f:
                    shapley[min(f, key=order.index)] += 1
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[1]]
                stay = [x for x in left if k not in x[1]]
                out[part, "".join(order), step] = (
                    len(stay), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == k for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[k],
                )
                left = stay
    return out


LONG = " ".join(f"word{i}" for i in range(250))
CASES = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (3, LONG, None), (None, LONG, "en"),
    (4, None, "en"), (5, "", None), (6, " \t\n\x0b ", ""), (7, "A", "en"), (8, "é" * 40 + "A", "fr"),
    (9, "a b " * 200, "en"), (10, "a" * 96 + "ABC", "en"), (11, "a" * 95 + "ABCD", "en"), (12, LONG + " 5%", "de"),
    (13, "the same " * 30_000, "en"), (14, "the same " * 30_000, "de"), (None, "x", "en"), (None, "x", "en"),
    (15, "Word word WORD # | " * 60, "fr"), (6, "tie", "en"), (6, "tie", "de"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, 1), (13, 1, None), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("marks", [MARKS, []], ids=["labels", "none"])
def test_audit_equals_brute_force(spark, marks):
    docs = spark.createDataFrame([(i, t, p, "clash", "clash", "clash") for i, t, p in CASES], DOCS)
    found = audit.audit(docs, spark.createDataFrame(marks, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(found) == len(got) and got == by_force(CASES, marks)


def test_no_documents_no_parts(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(MARKS, LABELS)).count() == 0


def test_machine_counts_like_python():
    texts = ["", "Ab #c\n", " x ", "Éa|b  $", None, "ÀB　C d", "d d D"]
    want = []
    for t in texts:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        want.append((len(w), len(set(w)), len(t), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t)))
    assert list(audit.measured(pa.array(texts))) == want
    data = np.frombuffer("ab c".encode(), np.uint8)
    opens, closes = audit.spans(audit.transduce(data, np.array([0, 1, 4])), data, np.array([0, 1, 4]))
    assert list(zip(opens, closes)) == [(0, 1), (1, 2), (3, 4)]
