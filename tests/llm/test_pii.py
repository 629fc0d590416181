import hashlib
import random
import re

from cinequery.llm import pii

#: The contract's patterns as written.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def corpus():
    rng = random.Random(8)
    bits = ["a.b@c.de", "x@y", "me@mail4.example.com", "a@b.co_x@y.zz", "1.2.3.4", "256.1.1.1", "001.02.3.255.7", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (706) 555-3138", "+12", "+1 ((((", "++49 30 1234567", "é", "😀", "日本", " call ", "\n", "%", "@", ".", "-", "5500000000000004 12", "b@@c.d.e.", "(555) 123-4567", "bob [at] mail [dot] com"]
    texts = [None, "", "no data", "9" * 3000, "a." * 4000, "x" * 5000 + "@", "a@" + "b." * 500 + "c", "+1" * 200, " ".join(["me@mail.example.com"] * 700)]
    return texts + [(" " if rng.random() < 0.5 else "").join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def joined(spans):
    order = list(PLAIN)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1])))


def test_base_spans_match_the_patterns_as_written(spark):
    texts = corpus()
    rows = [(i, t, ["clash"], "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string, spans array<string>, hint string")).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (t, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined(want).split(",")) - {""} <= set(spans) and len(spans) == len(want) + r.n_added


def test_votes_add_spans_with_support_and_no_others(spark):
    texts = ["write me: bob (at) mail (dot) com today"] + ["my phone: (555) 123-4567 ok"] * 3 + ["section 555-123-4567 of the code"] + ["mail me at amy@mail.com or call +1 (706) 555-3138"] * 20
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].spans == "email:10:33" and got[1].spans == "phone:10:24" and got[4].spans == ""


def test_mask(spark):
    rows = [(1, "é amy@mail.com, +1 (706) 555-3138!", 99, "a", "b"), (2, None, None, "a", "b"), (3, "clean", 5, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string, row string")
    got = pii.mask(df)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars, r.spans) for r in got.collect()} == {1: ("é [EMAIL], [PHONE]!", 19, "a"), 2: (None, None, "a"), 3: ("clean", 5, "a")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(empty).count() == 0 and pii.mask(empty).count() == 0


def test_posteriors_match_plain_maximisation():
    """The same rounds over single spans instead of counted patterns."""
    rng = random.Random(3)
    spans = []
    for _ in range(300):
        true = rng.random() < 0.4
        spans.append(tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < r) == true else -1) for r in (0.95, 0.8, 0.7, 0.6, 0.9)))
    counts = {v: spans.count(v) for v in spans}
    grid = sorted(counts)
    right, prior = [pii.TRUST[0] / sum(pii.TRUST)] * 5, {True: pii.PRIOR, False: pii.PRIOR}
    for _ in range(pii.ROUNDS + 1):
        belief = []
        for v in spans:
            yes, no = prior[v[0] > 0], 1 - prior[v[0] > 0]
            for x, r in zip(v, right, strict=True):
                yes, no = (yes * r, no * (1 - r)) if x > 0 else (yes * (1 - r), no * r) if x < 0 else (yes, no)
            belief.append(yes / (yes + no))
        last = dict(zip(spans, belief, strict=True))
        right = [(pii.TRUST[0] + sum(q if v[i] > 0 else 1 - q for v, q in zip(spans, belief, strict=True) if v[i])) / (sum(pii.TRUST) + sum(v[i] != 0 for v in spans)) for i in range(5)]
        prior = {k: (pii.PRIOR * pii.PRIOR_SPANS + sum(q for v, q in zip(spans, belief, strict=True) if (v[0] > 0) == k)) / (pii.PRIOR_SPANS + sum((v[0] > 0) == k for v in spans)) for k in (True, False)}
    got = pii._posteriors(sorted(counts.items()), grid)
    assert max(abs(g - last[v]) for g, v in zip(got, grid, strict=True)) < 1e-9


def test_classifier_gradient_matches_finite_differences(monkeypatch):
    import math

    rng = random.Random(4)
    grid = [tuple(rng.choice((-1, 0, 1)) for _ in range(9)) for _ in range(40)]
    weights, target = [rng.random() for _ in grid], [rng.random() for _ in grid]
    monkeypatch.setattr(pii, "STEPS", 1)
    yes, no, constant = pii._logistic(grid, weights, target)

    def loss(y, n, c):
        total = 0.0
        for v, w, t in zip(grid, weights, target, strict=True):
            z = c + sum(y[i] if x > 0 else n[i] if x < 0 else 0.0 for i, x in enumerate(v))
            total -= w / sum(weights) * (t * math.log(1 / (1 + math.exp(-z))) + (1 - t) * math.log(1 / (1 + math.exp(z))))
        return total

    zero, e = [0.0] * 9, 1e-5
    for i in range(9):
        up = [e if k == i else 0.0 for k in range(9)]
        assert abs(yes[i] / -4 - (loss(up, zero, 0.0) - loss(zero, zero, 0.0)) / e) < 1e-4
        assert abs(no[i] / -4 - (loss(zero, up, 0.0) - loss(zero, zero, 0.0)) / e) < 1e-4
    assert abs(constant / -4 - (loss(zero, zero, e) - loss(zero, zero, 0.0)) / e) < 1e-4


def test_marks_reach_the_classifier(spark):
    frame = spark.createDataFrame([(1, "x555-123-4567 and (555) 123-4567, 2001:0db8:85a3:0000:0000:8a2e:0370:7334")], "doc_id long, text string")
    spans = pii.candidates(frame).first().spans
    assert spans and all(len(s.votes) == pii.LABELERS and len(s.marks) == pii.MARKS and set(s.marks) <= {-1, 0, 1} for s in spans)
    yes, no, _ = pii.fit(pii.candidates(frame)).weights[3]
    assert len(yes) == len(no) == pii.LABELERS + pii.MARKS
