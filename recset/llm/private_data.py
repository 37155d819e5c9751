"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of base patterns (email, ip, card, phone) and of looser forms (obfuscated addresses, numbers
without country code, long hexadecimal addresses). Four labelers vote on each candidate, for (1), against (-1) or not at
all (0): the pattern's own check, a gazetteer (top-level domains, issuer and area prefixes, address ranges), cue words
before the span, and the characters that touch it. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is for each kind, and how likely each pattern is personal data. With these probabilities as
labels a logistic regression over the votes and the form of a span is trained; it decides on the candidates that are no
base match. Base matches stay in any case; an added span never overlaps one.

Only counts of vote patterns reach the driver, at most PATTERNS rows at any size of the corpus. Matches are found without
leaving the row; positions are running sums over the pieces between matches, in chunks, so that many matches in one long
text stay near linear.

Defined results: null text is empty. Positions are code points, end exclusive. Repeated rows stay repeated; an empty table
gives an empty result (and a model that adds nothing). Other columns are carried along.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import free_name, table, written
from recset.llm.queries import query

KINDS = ["email", "ip", "card", "phone"]
VOTES = ["pattern", "gazetteer", "context", "edge"]
PATTERNS = len(KINDS) * 3 ** len(VOTES) * 3
ACCEPT = 0.9
CHUNK = 256

# Base patterns; each match is the maximal one from its start, so anchors and possessive loops change no match and keep
# the search linear on long runs. A card is looked for with its number of digits, since longer and shorter runs fail.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
# Whole forms that a base match swallows and then fails on, since it runs on into the digits next to them.
WHOLE = {
    "card": r"(?<![0-9A-Za-z.-])[0-9]{13,19}(?![0-9A-Za-z.-])",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# A text without this character has no match (cheap test before the pattern).
NEEDS = {("email", "base"): "@", ("phone", "base"): "+", ("ip", "base"): ".", ("ip", "loose"): ":", ("phone", "whole"): "+"}
CUES = {
    "email": ("mail|contact|write to|reach|courriel|correo|kontakt", "example|version"),
    "ip": (r"\bip\b|host|server|login|address|adresse|client|from", r"\bv\b|version|section|chapter|release"),
    "card": ("card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", "order|isbn|serial|token|invoice|id[ :]*$|="),
    "phone": (r"phone|call|tel|mobile|cell|fax|dial|sms|appel|llam|\bruf", "order|isbn|serial|version|token|="),
}
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|us|ca|eu|ch|at|nl|be|pl|ru|cn|jp|in|br|au|mx|se|no|dk|fi"
DIGITS = "regexp_replace(s.v, r'[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(transform(split(s.v, '[.]'), e -> regexp_replace(e, '^0+', '')), e -> length(e) < 3 OR (length(e) = 3 AND e <= '255'))",
    "card": f"""aggregate(sequence(1, length({DIGITS})), 0L, (t, i) -> t + CASE WHEN i % 2 = 1 THEN int(substr({DIGITS}, -i, 1))
        ELSE (2 * int(substr({DIGITS}, -i, 1))) div 10 + (2 * int(substr({DIGITS}, -i, 1))) % 10 END) % 10 = 0""",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}
GAZETTEER = {
    "email": f"CASE WHEN lower(s.v) RLIKE r'[.\\s)\\]]({DOMAINS})$' THEN 1 ELSE -1 END",
    "ip": "CASE WHEN instr(s.v, ':') > 0 THEN 0 WHEN s.v RLIKE r'^(0|127|22[4-9]|2[3-9][0-9])[.]' THEN -1 ELSE 1 END",
    "card": f"CASE WHEN {DIGITS} RLIKE r'^(4|5[1-5]|2[2-7]|3[0-8]|6)' THEN 1 ELSE -1 END",
    "phone": f"""CASE WHEN {DIGITS} RLIKE r'^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$' THEN 1 WHEN length({DIGITS}) > 15 THEN -1 ELSE 0 END""",
}
SPAN = "array<struct<start:bigint,end:bigint,v:string,before:string,after:string>>"


def _matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Add an array of spans for each named pattern: {name: (pattern, character that a match needs or None)}."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    found = {f"m_{n}": F.when(F.instr(t, c) > 0 if c else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, (p, c) in patterns.items()}
    df = df.withColumns(found)
    df = df.withColumns({f"p_{n}": F.when(F.size(f"m_{n}") > 0, F.split(t, p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    lens = {f"c_{n}": F.expr(f"""transform(CASE WHEN size(m_{n}) > 0 THEN sequence(0, (size(m_{n}) - 1) div {CHUNK}) ELSE array() END,
        k -> zip_with(slice(p_{n}, k * {CHUNK} + 1, least({CHUNK}, size(m_{n}) - k * {CHUNK})), slice(m_{n}, k * {CHUNK} + 1, {CHUNK}),
        (a, b) -> named_struct('g', bigint(length(a)), 'l', bigint(length(b)))))""") for n in patterns}
    df = df.withColumns(lens)
    df = df.withColumns({f"o_{n}": F.expr(f"aggregate(c_{n}, array(0L), (a, c) -> concat(a, array(element_at(a, -1) + aggregate(c, 0L, (t, x) -> t + x.g + x.l))))") for n in patterns})
    at = "named_struct('at', acc.at + x.g + x.l, 'out', concat(acc.out, array(named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.l))))"
    df = df.withColumns({f"s_{n}": F.expr(f"""flatten(transform(c_{n}, (c, k) -> aggregate(c,
        named_struct('at', o_{n}[k], 'out', cast(array() AS array<struct<start:bigint,end:bigint>>)), (acc, x) -> {at}, acc -> acc.out)))""") for n in patterns})
    spans = {n: F.expr(f"""cast(transform(s_{n}, (x, i) -> named_struct('start', x.start, 'end', x.end, 'v', m_{n}[i],
        'before', lower(right(p_{n}[i], 40)), 'after', left(p_{n}[i + 1], 1))) AS {SPAN})""") for n in patterns}
    df = df.withColumns(spans)
    return df.drop(*[f"{x}_{n}" for x in "mpcos" for n in patterns])


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """`docs` with an array of candidates: kind (number in KINDS), form (0 base, 1 base pattern that fails its check, 2
    loose, or whole form next to other digits), start, end, and the votes."""
    keep = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    patterns = {f"{k}_{f}": (p, NEEDS.get((k, f))) for f, own in (("base", BASE), ("loose", LOOSE), ("whole", WHOLE)) for k, p in own.items()}
    inner = _matches(inner, "body", patterns)
    parts = []
    for n in patterns:
        kind, kind_form = n.split("_")
        good, bad = CUES[kind]
        form = f"CASE WHEN {CHECKS[kind]} THEN 0 ELSE 1 END" if kind_form == "base" else "2"
        parts.append(f"""transform({n}, s -> named_struct('kind', {KINDS.index(kind)}, 'form', {form}, 'start', s.start, 'end', s.end,
            'pattern', {f"CASE WHEN {CHECKS[kind]} THEN 1 ELSE -1 END" if kind_form != "loose" else "0"}, 'gazetteer', {GAZETTEER[kind]},
            'context', CASE WHEN s.before RLIKE r'{bad}' THEN -1 WHEN s.before RLIKE r'{good}' THEN 1 ELSE 0 END,
            'edge', CASE WHEN s.before RLIKE r'[\\p{{L}}0-9_]$' OR s.after RLIKE r'[\\p{{L}}0-9_]' THEN -1 ELSE 0 END))""")
    inner = inner.withColumn("c", F.expr(f"concat({', '.join(parts)})"))
    return inner.select("doc.*", F.col("c").alias(out))


class SpanModel:
    """Reliabilities of the labelers and the span classifier, fitted to counts of (kind, form, votes)."""

    def __init__(self, counts: list[tuple], rounds: int = 50):
        """counts: rows (kind, form, *votes, n)."""
        self.counts = counts
        # Probability of each vote for spans that are not / are personal data, by kind; the start prefers honest labelers.
        # A pattern's own check is trusted more than the others from the start.
        prior = {0: {1: 1.0, 0: 2.0, -1: 3.0}, 1: {1: 3.0, 0: 2.0, -1: 1.0}}
        strong = {0: {1: 1.0, 0: 5.0, -1: 20.0}, 1: {1: 20.0, 0: 5.0, -1: 0.2}}
        start = {j: strong if j == 0 else prior for j in range(len(VOTES))}
        self.rates = {k: {j: {y: _shares(start[j][y]) for y in (0, 1)} for j in range(len(VOTES))} for k in range(len(KINDS))}
        self.share = {k: 0.5 for k in range(len(KINDS))}
        for _ in range(rounds if counts else 0):
            total = {k: {j: {y: dict(start[j][y]) for y in (0, 1)} for j in range(len(VOTES))} for k in range(len(KINDS))}
            mass = {k: [1.0, 1.0] for k in range(len(KINDS))}
            for kind, _, *votes, n in counts:
                q = self.posterior(kind, votes)
                for y, w in ((0, n * (1 - q)), (1, n * q)):
                    mass[kind][y] += w
                    for j, v in enumerate(votes):
                        total[kind][j][y][v] += w
            self.rates = {k: {j: {y: _shares(total[k][j][y]) for y in (0, 1)} for j in range(len(VOTES))} for k in total}
            self.share = {k: m[1] / sum(m) for k, m in mass.items()}
        self.weights = self._classifier()

    def posterior(self, kind: int, votes: list[int]) -> float:
        p = [1 - self.share[kind], self.share[kind]]
        for j, v in enumerate(votes):
            p = [p[y] * self.rates[kind][j][y][v] for y in (0, 1)]
        return p[1] / (p[0] + p[1])

    @staticmethod
    def features(kind: int, form: int, votes: list[int]) -> list[float]:
        return [*[float(kind == k) for k in range(len(KINDS))], float(form == 1), float(form == 2), *map(float, votes)]

    def _classifier(self, rounds: int = 30, ridge: float = 0.01) -> list[float]:
        """Logistic regression on the probabilities by Newton steps, a row for each vote pattern. Patterns count by the
        root of their number, so that rare forms matter."""
        rows = [(self.features(k, f, v), self.posterior(k, v), math.sqrt(n)) for k, f, *v, n in self.counts]
        size = len(KINDS) + 2 + len(VOTES)
        w = [0.0] * size
        for _ in range(rounds if rows else 0):
            grad = [ridge * x for x in w]
            curve = [[ridge * (i == j) for j in range(size)] for i in range(size)]
            for x, q, n in rows:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
                some = [k for k in range(size) if x[k]]
                for i in some:
                    grad[i] += (p - q) * n * x[i]
                    for j in some:
                        curve[i][j] += max(p * (1 - p), 1e-6) * n * x[i] * x[j]
            w = [a - b for a, b in zip(w, _solved(curve, grad))]
        return w

    def accepts(self) -> str:
        """SQL condition on a candidate c."""
        if not self.counts:
            return "false"
        names = [*[f"int(c.kind = {k})" for k in range(len(KINDS))], "int(c.form = 1)", "int(c.form = 2)", *[f"c.{v}" for v in VOTES]]
        total = " + ".join(f"{w!r}D * {n}" for w, n in zip(self.weights, names))
        return f"({total}) >= {math.log(ACCEPT / (1 - ACCEPT))!r}D"


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small positive definite system."""
    n = len(b)
    rows = [[*r, x] for r, x in zip(a, b)]
    for i in range(n):
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def _shares(n: dict[int, float]) -> dict[int, float]:
    total = sum(n.values())
    return {v: x / total for v, x in n.items()}


def fit(found: DataFrame, column: str = "candidates") -> SpanModel:
    c = found.select(F.explode(column).alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in ("kind", "form", *VOTES)]).agg(F.count("*").alias("n"))
    return SpanModel([tuple(r) for r in c.orderBy("kind", "form", *VOTES).collect()])  # PATTERNS rows at most


def spans(found: DataFrame, model: SpanModel, column: str = "candidates", base: str = "base", all_: str = "spans") -> DataFrame:
    """Replace the candidates by two sorted arrays of (kind, start, end): base spans, and all spans."""
    short = "transform({}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"
    b, m, w = (free_name(found, n) for n in ("base_part", "more_part", "wide_part"))
    found = found.withColumn(b, F.expr(f"filter(`{column}`, c -> c.form = 0)"))
    found = found.withColumn(m, F.expr(f"""filter(`{column}`, c -> c.form > 0 AND {model.accepts()}
        AND NOT exists(`{b}`, e -> e.start < c.end AND c.start < e.end))"""))
    # Of added spans that overlap, the one that starts first stays, or the longer one.
    found = found.withColumn(w, F.expr(f"""filter(`{m}`, c -> NOT exists(`{m}`, e -> e.start < c.end AND c.start < e.end
        AND (e.start < c.start OR (e.start = c.start AND (e.end > c.end OR (e.end = c.end AND e.kind < c.kind))))))"""))
    out = found.withColumns({base: F.expr(f"array_sort({short.format(f'`{b}`')})"), all_: F.expr(f"array_sort({short.format(f'concat(`{b}`, `{w}`)')})")})
    return out.drop(b, m, w, *([column] if column not in (base, all_) else []))


def listed(column: str) -> str:
    """kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(`{column}`, c -> concat(array({names})[c.kind], ':', c.start, ':', c.end)), ',')"


def redacted(text: str, column: str) -> str:
    """The text with each span (spans that overlap count as one) replaced by its kind in angle brackets."""
    joined = f"""aggregate(array_sort(transform(`{column}`, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind))),
        cast(array() AS array<struct<start:bigint,end:bigint,kind:int>>),
        (a, c) -> CASE WHEN size(a) > 0 AND element_at(a, -1).end > c.start
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, c.end), 'kind', element_at(a, -1).kind)))
            ELSE concat(a, array(c)) END)"""
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    return f"""CASE WHEN size(`{column}`) > 0 THEN aggregate({joined}, named_struct('out', '', 'at', 0L),
        (a, c) -> named_struct('out', concat(a.out, substring(`{text}`, int(a.at) + 1, int(c.start - a.at)), array({names})[c.kind]), 'at', c.end),
        a -> concat(a.out, substring(`{text}`, int(a.at) + 1))) ELSE `{text}` END"""


@query("op7_private_data")
def op7_private_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = written(candidates(docs).drop("text"), "candidates")
    done = spans(found, fit(found))
    number = [F.expr(f"bigint(size(filter(base, c -> c.kind = {k})))").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return done.select("doc_id", *number, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("spans")).alias("spans"))
