"""Personal data by weak supervision, in DataFrame and SQL expressions alone.

Regular expressions propose spans. Labelers (strict pattern, checksum or form, gazetteer, context
before the span, counter-context) vote on each; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how common true spans are; a logistic span
classifier is then trained on the resulting posteriors, over the votes and marks of the span itself
(length, digits, separators, what stands next to it), and decides on the spans that no strict
pattern vouches for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns of the contract. Where a run of a class must be taken whole or
#: not at all they are written possessive, and starts inside such a run are passed over unless the
#: last match ended there; that finds the same spans in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose spans the votes must carry: spelled-out addresses, full IPv6, and national telephone forms. Cards have none: what fails the checksum is no card.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: A quick test that a text can hold a match at all.
HINT = {
    ("email", True): "instr(text, '@') > 0",
    ("email", False): "(instr(text, '[at]') > 0 OR instr(text, '(at)') > 0)",
    ("ip", True): r"text rlike '[0-9]\\.[0-9]'",
    ("ip", False): "instr(text, ':') > 0",
    ("card", True): r"text rlike '[0-9][\\x20-]?[0-9]'",
    ("phone", True): "instr(text, '+') > 0",
    ("phone", False): r"text rlike '[0-9][.-][0-9]'",
}
#: Words before a span that speak for its kind, or against any.
CUES = {
    "email": "mail|contact|write|reach|courriel|correo|adresse",
    "ip": "ip|address|host|server|login|adresse|client",
    "card": "card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|reach|anruf|appel",
}
AGAINST = "version|release|isbn|serial|token|sku|build|section|chapter"
#: Ends of mail domains, and first digits of card issuers.
DOMAINS = r"(\\.|dot.)\\x20?(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
CONTEXT = 40
#: Rounds of expectation-maximisation and of gradient steps.
ROUNDS, STEPS = 40, 150
#: Share of proposed spans that are true before any is counted and spans that it counts as, and votes (right, wrong) that a labeler starts with.
PRIOR, PRIOR_SPANS, TRUST = 0.2, 1000.0, (8.0, 2.0)
#: Labelers, and marks of a span.
LABELERS, MARKS = 5, 4


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(lengths: str) -> str:
    """SQL: sums of an array of longs before each element. In parts of 256, so the work stays linear in long arrays."""
    parts = f"transform(sequence(0, greatest(0, (size({lengths}) - 1) div 256)), k -> slice({lengths}, k * 256 + 1, 256))"
    before = f"""aggregate({parts}, named_struct('all', CAST(array() AS ARRAY<BIGINT>), 'sum', 0L),
        (s, part) -> named_struct('all', array_append(s.all, s.sum), 'sum', s.sum + aggregate(part, 0L, (a, x) -> a + x)), s -> s.all)"""
    inside = "aggregate(part, named_struct('all', CAST(array() AS ARRAY<BIGINT>), 'sum', base), (s, x) -> named_struct('all', array_append(s.all, s.sum), 'sum', s.sum + x), s -> s.all)"
    return f"flatten(zip_with({parts}, {before}, (part, base) -> {inside}))"


def _located(df: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """df with an array column: start, end (code points), match and what stands before it, of each match in text."""
    q = _quoted(pattern)
    df = df.withColumn("hint", F.expr(f"coalesce({hint}, false)"))
    df = df.withColumn("found", F.expr(f"IF(hint, regexp_extract_all(text, {q}, 0), CAST(array() AS ARRAY<STRING>))"))
    df = df.withColumn("gaps", F.expr(f"IF(size(found) > 0, split(text, {q}, -1), CAST(array() AS ARRAY<STRING>))"))
    df = df.withColumn("lengths", F.expr("zip_with(found, slice(gaps, 1, size(found)), (m, g) -> CAST(char_length(g) + char_length(m) AS BIGINT))"))
    df = df.withColumn("starts", F.expr(f"IF(size(found) > 0, {_starts('lengths')}, CAST(array() AS ARRAY<BIGINT>))"))
    spans = f"""transform(found, (m, i) -> named_struct(
        'start', starts[i] + char_length(gaps[i]), 'end', starts[i] + char_length(gaps[i]) + char_length(m),
        'match', m, 'before', lower(right(gaps[i], {CONTEXT}))))"""
    return df.withColumn(name, F.expr(spans)).drop("hint", "found", "gaps", "lengths", "starts")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = f"reverse({_digits(x)})"
    # Twice a digit, its own digits added, modulo ten: 0 2 4 6 8 1 3 5 7 9.
    return f"""(aggregate(transform(split({d}, ''), (c, i) -> IF(i % 2 = 0, CAST(c AS INT), CAST(substring('0246813579', CAST(c AS INT) + 1, 1) AS INT))), 0, (s, x) -> s + x) % 10 = 0)"""


#: Whether a base match passes its filter.
PASSES = {
    "email": "true",
    "ip": r"m.match rlike '^(0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\\.|$)){4}$'",
    "card": f"char_length({_digits('m.match')}) BETWEEN 16 AND 19 AND {_luhn('m.match')}",
    "phone": f"char_length({_digits('m.match')}) BETWEEN 8 AND 15",
}


def _votes(kind: str, base: bool) -> str:
    """SQL: five votes on the span m, each 1 for, -1 against, 0 neither."""
    form = {
        "email": r"IF(m.match rlike '[._%+-]@|^[._%+-]', -1, 1)",
        "ip": r"IF(m.match rlike '^0|\\.0[0-9]', -1, 1)",
        "card": r"IF(m.match rlike '^[0-9]+$|^([0-9]{4}[\\x20-]){3}[0-9]{4,7}$', 1, -1)",
        "phone": f"IF(char_length({_digits('m.match')}) BETWEEN 10 AND 13, 1, -1)",
    }[kind]
    gazetteer = {
        "email": f"IF(lower(m.match) rlike '{DOMAINS}', 1, 0)",
        "ip": r"IF(m.match rlike '^(0|127|255)\\.', -1, 0)",
        "card": "IF(m.match rlike '^[3-6]', 1, 0)",
        "phone": r"IF(m.match rlike '^\\+(1|33|34|44|49)[^0-9]', 1, 0)",
    }[kind]
    return f"""array({1 if base else 0}, {form}, {gazetteer}, IF(m.before rlike '({CUES[kind]})[^.;!?]{{0,16}}$', 1, 0), IF(m.before rlike '({AGAINST})[^a-z]{{0,6}}$', -1, 0))"""


def _marks(kind: str) -> str:
    """SQL: marks of the span m, each 1, -1 or 0 between: long or short for its kind, mostly or hardly digits, many separators or none, apart from or stuck to the letter before."""
    short, long = {"email": (12, 24), "ip": (9, 14), "card": (16, 19), "phone": (12, 16)}[kind]
    size, digits = "char_length(m.match)", f"char_length({_digits('m.match')})"
    signs = "char_length(regexp_replace(m.match, '[A-Za-z0-9]', ''))"
    return f"""array(CASE WHEN {size} >= {long} THEN 1 WHEN {size} < {short} THEN -1 ELSE 0 END, CASE WHEN {digits} * 10 >= {size} * 8 THEN 1 WHEN {digits} * 10 < {size} * 3 THEN -1 ELSE 0 END,
        CASE WHEN {signs} >= 3 THEN 1 WHEN {signs} = 0 THEN -1 ELSE 0 END, CASE WHEN m.before = '' THEN 0 WHEN right(m.before, 1) rlike '[a-z0-9]' THEN -1 ELSE 1 END)"""


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with spans: array of (kind number, start, end, base, votes, marks), base spans and wide ones that overlap no base span of their kind."""
    df = docs
    parts = []
    for k, kind in enumerate(KINDS):
        df = _located(df, f"base {kind}", BASE[kind], HINT[kind, True])
        df = df.withColumn(f"base {kind}", F.expr(f"filter(`base {kind}`, m -> {PASSES[kind]})"))
        struct = "named_struct('kind', {k}, 'start', m.start, 'end', m.end, 'base', {b}, 'votes', {v}, 'marks', {m})"
        parts.append(f"transform(`base {kind}`, m -> {struct.format(k=k, b='true', v=_votes(kind, True), m=_marks(kind))})")
        if kind in WIDE:
            df = _located(df, f"wide {kind}", WIDE[kind], HINT[kind, False])
            apart = f"filter(`wide {kind}`, m -> NOT exists(`base {kind}`, b -> b.start < m.end AND m.start < b.end))"
            parts.append(f"transform({apart}, m -> {struct.format(k=k, b='false', v=_votes(kind, False), m=_marks(kind))})")
    df = df.withColumn("spans", F.expr(f"concat({', '.join(parts)})"))
    return df.select(*docs.columns, "spans")


@dataclass
class SpanClassifier:
    """Weights of a logistic model for each kind: one for each vote for and mark of 1, one for each against and of -1, and a constant."""

    weights: dict[int, tuple[list[float], list[float], float]]

    def sql(self, s: str) -> str:
        cases = []
        for kind, (yes, no, constant) in sorted(self.weights.items()):
            fields = [f"{s}.votes[{i}]" if i < LABELERS else f"{s}.marks[{i - LABELERS}]" for i in range(len(yes))]
            terms = " + ".join(f"CASE {x} WHEN 1 THEN {a!r}D WHEN -1 THEN {b!r}D ELSE 0D END" for x, a, b in zip(fields, yes, no, strict=True))
            cases.append(f"WHEN {kind} THEN {constant!r}D + {terms}")
        return f"(CASE {s}.kind {' '.join(cases)} ELSE -1D END > 0)" if cases else "false"


def _posteriors(patterns: list[tuple[tuple[int, ...], int]], grid: list[tuple[int, ...]]) -> list[float]:
    """Expectation-maximisation over vote patterns and their counts: a hidden truth as common as the spans believed true, counted apart with and without the strict pattern (the first vote), labelers right with a reliability each, apart from what they abstain on. Returns P(true) of each pattern of ``grid``."""
    width = len(grid[0])
    right, prior = [TRUST[0] / sum(TRUST)] * width, [PRIOR, PRIOR]

    def belief(votes: tuple[int, ...]) -> float:
        share = prior[votes[0] > 0]
        odds = math.log(share / (1 - share)) + sum(v * math.log(right[i] / (1 - right[i])) for i, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    for _ in range(ROUNDS):
        hits, all_ = [TRUST[0]] * width, [sum(TRUST)] * width
        true, spans = [PRIOR * PRIOR_SPANS] * 2, [PRIOR_SPANS] * 2
        for votes, n in patterns:
            q = belief(votes)
            true[votes[0] > 0] += n * q
            spans[votes[0] > 0] += n
            for i, v in enumerate(votes):
                if v:
                    hits[i] += n * (q if v > 0 else 1 - q)
                    all_[i] += n
        right = [min(0.99, h / a) for h, a in zip(hits, all_, strict=True)]
        prior = [min(0.99, t / n) for t, n in zip(true, spans, strict=True)]
    return [belief(votes) for votes in grid]


def _logistic(grid: list[tuple[int, ...]], weights: list[float], target: list[float]) -> tuple[list[float], list[float], float]:
    """Gradient steps on the weighted log loss against the posteriors."""
    width = len(grid[0])
    yes, no, constant = [0.0] * width, [0.0] * width, 0.0
    total = sum(weights)
    for _ in range(STEPS):
        gy, gn, gc = [0.0] * width, [0.0] * width, 0.0
        for votes, w, t in zip(grid, weights, target, strict=True):
            z = constant + sum(yes[i] if v > 0 else no[i] if v < 0 else 0.0 for i, v in enumerate(votes))
            e = (1 / (1 + math.exp(-z)) - t) * w / total
            gc += e
            for i, v in enumerate(votes):
                if v > 0:
                    gy[i] += e
                elif v < 0:
                    gn[i] += e
        yes = [w - 4 * g for w, g in zip(yes, gy, strict=True)]
        no = [w - 4 * g for w, g in zip(no, gn, strict=True)]
        constant -= 4 * gc
    return yes, no, constant


def fit(spans: DataFrame) -> SpanClassifier:
    """Learns from all spans of ``spans`` (as ``candidates`` gives them); what reaches the driver is a row for each kind, vote pattern and pattern of marks, 3^9 a kind at most."""
    counts = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.marks").count().collect()
    grid = [*product((-1, 0, 1), repeat=LABELERS)]
    weights = {}
    for kind in sorted({r.kind for r in counts}):
        seen: dict[tuple[int, ...], int] = {}
        for r in counts:
            if r.kind == kind:
                seen[tuple(r.votes)] = seen.get(tuple(r.votes), 0) + r["count"]
        belief = dict(zip(grid, _posteriors(sorted(seen.items()), grid), strict=True))
        # Patterns of votes not seen weigh a little, so that the classifier is defined on them too; they say nothing of marks.
        rows = [(v + (0,) * MARKS, 0.2, belief[v]) for v in grid]
        rows += sorted((tuple(r.votes) + tuple(r.marks), math.log1p(r["count"]), belief[tuple(r.votes)]) for r in counts if r.kind == kind)
        weights[kind] = _logistic(*map(list, zip(*rows, strict=True)))
    return SpanClassifier(weights)


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort(transform({spans}, s -> named_struct('k', s.kind, 'a', s.start, 'b', s.end))), s -> concat_ws(':', array({names})[s.k], CAST(s.a AS STRING), CAST(s.b AS STRING))), ',')"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row of ``docs``. Null texts are empty; repeated rows stay; an empty table gives an empty result, and texts of any length are read whole. Spans are found once, kept in a checkpoint without the texts, and then learned from and judged."""
    found = cut(candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "spans"))
    chosen = F.expr(f"filter(spans, s -> s.base OR {fit(found).sql('s')})")
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = {k})) AS BIGINT) AS n_{kind}") for k, kind in enumerate(KINDS)]
    base = F.expr(f"sha2({_joined('filter(spans, s -> s.base)')}, 256) AS base_sha256")
    return found.withColumn("chosen", chosen).select("doc_id", *counts, base, F.expr(f"{_joined('chosen')} AS spans"), F.expr("CAST(size(filter(chosen, s -> NOT s.base)) AS BIGINT) AS n_added"))


def mask(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with each span of personal data in text replaced by its kind in brackets, of overlapping ones the first; n_chars, if there, counts the new text. All columns stay, nulls too."""
    classifier = classifier or fit(cut(candidates(docs.select("text")).select("spans")))  # found once and kept without the texts, as what is read of them would be found anew
    rows = candidates(docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))).withColumn("spans", F.expr(f"array_sort(transform(filter(spans, s -> s.base OR {classifier.sql('s')}), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    masked = F.expr(f"""CASE WHEN size(spans) = 0 THEN text ELSE aggregate(spans, named_struct('out', CAST(array() AS ARRAY<STRING>), 'at', 0L),
        (s, x) -> IF(x.start < s.at, named_struct('out', s.out, 'at', greatest(s.at, x.end)),
            named_struct('out', array_append(array_append(s.out, substring(text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT))), array({names})[x.kind]), 'at', x.end)),
        s -> concat(array_join(s.out, ''), substring(text, CAST(s.at + 1 AS INT)))) END""")
    out = rows.withColumn("masked", masked)
    changed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("masked")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
