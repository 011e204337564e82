"""Personal data: spans by fixed formats, and more spans chosen by boosted trees.

Four base kinds (email, ip, card, phone) are found by format and check. Beside
them, generators with wider patterns propose candidates that may overlap. A
candidate is described by a few small integers: its generator, digits, groups,
separators, what stands beside it and which telling word stands before it.

The trees learn which of these look like personal data. Their labels are the
candidates that a base kind confirms or that have evidence of their own: check
digits of account numbers, eight groups of a network address, a spelled-out
address that ends in a name, a telling word right before a number. Neither the
checks nor the evidence are features. Since all features are small integers,
the candidates of the whole corpus are counted per combination by Spark, and
the boosting works on those counts. One half of the documents fits the trees,
the other half calibrates, for every generator and on the candidates outside
base spans, the lowest score at which the confirmed share reaches
``precision``. Candidates with evidence or from that score on are added to the
base spans, the best first, where they touch no other span.

Everything runs as DataFrame expressions; the trees become CASE expressions.
Positions count code points, the end is exclusive.

Defined results: a null or empty text has no spans. Repeated rows are searched
each for itself. A corpus without candidates gives a model that adds only
what has evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import beside, whole_text

# The kinds in order, and their formats. They are written with
# possessive groups, which find the same spans without deep recursion, and
# begin a run of address characters only where one can begin.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IN_RANGE = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Characters of an account number after country and check digits, and the countries (ISO 13616).
ACCOUNT_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FI|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|XK|MN", 17: "CH|CR|HR|LI|LV",
    18: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|OM|SO|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST",
    22: "IS|TR", 23: "BI|DJ|FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV|NI", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE",
    27: "MT|SC", 28: "LC", 29: "RU",
}
_ACCOUNTS = "|".join(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])" for n, countries in ACCOUNT_LENGTHS.items())

# Wider patterns: addresses spelled out, numbers in groups, other network addresses, account numbers.
GENERATORS = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[a-z0-9-]++(?:(?:\.|\x20\.\x20?|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]++)++",
    "ip": r"(?:(?<![0-9.])|\G)[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+|(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}+:){4,7}+[0-9A-Fa-f]{1,4}+",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "account": rf"(?:(?<![A-Z0-9])|\G)(?:{_ACCOUNTS}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}+)",
}
NEEDS = {"email": r"@|[(\[](?i:at)[)\]]", "ip": r"[0-9.:]{4}", "number": r"[0-9]", "account": r"[A-Z]{2}[0-9]{2}"}
ADDED_KINDS = tuple(GENERATORS)
HINTS = r"[0-9@]|[(\[](?i:at)[)\]]"

# Evidence: what a spelled-out address and a network address must be, and what stands right before a phone number.
SPELLED = r"(?i)^[^@]+[(\[]at[)\]].*(?:\.|[)\]])\x20?[a-z]{2,24}$"
EIGHT_GROUPS = r"^(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}$"
CALLED = r"(?i)\b(?:phone|call|tel|telephone|fax|mobile|sms|whatsapp)(?:\x20(?:me|us|number|no|nr))?[\x20.:]{1,3}$"

# Telling words in the characters before a candidate.
CONTEXT_CHARS = 24
CONTEXT = (
    r"(?i)\b(?:mail|contact|phone|call|tel|fax|mobile|sms|whatsapp)",
    r"(?i)\b(?:card|visa|mastercard|iban|account|payment|konto|carte|tarjeta)",
    r"(?i)\b(?:version|license|isbn|page|no|nr|id|order|price|total)\b",
)
FEATURES = ("generator", "digits", "groups", "marks", "plus", "left", "right", "context")

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _matches(text: Column, pattern: str) -> Column:
    """Start, end and text of every match, leftmost and without overlap.

    The pieces between the matches tell where they are; both arrays come from
    the same scan order, and each pattern is run once for either.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(so_far: Column, pair: Column) -> Column:
        begin = so_far["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(pair["hit"].isNull(), so_far["spans"]).otherwise(F.concat(so_far["spans"], F.array(span))).alias("spans"),
        )

    return F.aggregate(zipped, start, step, lambda done: done["spans"])


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def step(total: Column, place: Column) -> Column:
        digit = F.substring(turned, place, F.lit(1)).cast("int") * (F.lit(2) - place % 2)
        return total + digit - F.when(digit > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _account_checks(hit: Column) -> Column:
    """Whether the number, with country and check digits moved to its end and letters as 10 to 35, leaves 1 over 97."""
    bare = F.regexp_replace(hit, r"\x20", "")
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        letter = char >= "A"
        value = F.when(letter, F.ascii(char) - 55).otherwise(char.cast("int"))
        return ((rest * F.when(letter, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0)), F.lit(0), step) == 1


def _evidence(kind: str, hit: Column, before: Column, digits: Column) -> Column:
    """What makes a candidate personal data beside the base formats."""
    if kind == "account":
        return _account_checks(hit)
    if kind == "email":
        return hit.rlike(SPELLED)
    if kind == "ip":
        return hit.rlike(EIGHT_GROUPS)
    return digits.between(7, 15) & before.rlike(CALLED)


def _base_kind(text: Column, kind: str, pattern: str, needs: Column, valid) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    rank = F.lit(BASE_KINDS.index(kind))
    spans = F.transform(
        F.filter(_matches(text, pattern), lambda m: valid(m["hit"])),
        lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(needs, spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    digits = text.rlike("[0-9]")

    def is_card(hit: Column) -> Column:
        bare = F.regexp_replace(hit, r"[\x20-]", "")
        return F.when(F.length(bare).between(14, 19), _luhn(bare)).otherwise(F.lit(False))

    return F.array_sort(F.concat(
        _base_kind(text, "email", EMAIL, F.contains(text, F.lit("@")), lambda hit: F.lit(True)),
        _base_kind(text, "ip", IP, digits, lambda hit: hit.rlike(IN_RANGE)),
        _base_kind(text, "card", CARD, digits, is_card),
        _base_kind(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda hit: F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)),
    ))


def _beside(char: Column) -> Column:
    """0: nothing or white space, 1: punctuation, 2: letter or digit."""
    return F.when(F.coalesce(char, F.lit("")).rlike(r"^\s*$"), 0).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1)


def _described(text: Column, kind: str, match: Column) -> Column:
    hit, start = match["hit"], match["start"]
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    groups = F.size(F.regexp_extract_all(hit, F.lit("[0-9]++"), F.lit(0)))
    before = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    context = F.lit(0)
    for number, pattern in reversed(list(enumerate(CONTEXT, 1))):
        context = F.when(before.rlike(pattern), number).otherwise(context)
    steps = (1, 7, 10, 12, 14, 17, 20)
    bucket = F.lit(0)
    for step in steps:
        bucket = bucket + (digits >= step).cast("int")
    values = {
        "generator": F.lit(ADDED_KINDS.index(kind)),
        "digits": bucket,
        "groups": F.least(groups, F.lit(5)),
        "marks": F.when(hit.rlike(r"[()\[]"), 3).when(hit.rlike(r"[.:]"), 2).when(hit.rlike(r"[\x20-]"), 1).otherwise(0),
        "plus": hit.startswith("+").cast("int"),
        "left": _beside(F.when(start > 0, F.substring(text, start, F.lit(1)))),
        "right": _beside(F.substring(text, match["end"] + 1, F.lit(1))),
        "context": context,
    }
    return F.struct(
        start.alias("start"), match["end"].alias("end"), *[values[name].cast("int").alias(name) for name in FEATURES],
        F.coalesce(_evidence(kind, hit, before, digits), F.lit(False)).cast("int").alias("evidence"),
    )


def candidates(text: Column) -> Column:
    """Proposed spans of all generators, with their features; they may overlap."""
    fields = ",".join(f"{name}:int" for name in ("start", "end", *FEATURES, "evidence"))
    none = F.array().cast(f"array<struct<{fields}>>")
    return F.concat(*[
        F.when(text.rlike(NEEDS[kind]), F.transform(_matches(text, pattern), partial(_described, text, kind))).otherwise(none)
        for kind, pattern in GENERATORS.items()
    ])


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested tuples (feature, threshold, low, high) or leaf values; a threshold per generator."""

    bias: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, features: dict[str, int]) -> float:
        total = self.bias
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if features[node[0]] <= node[1] else node[3]
            total += node
        return total

    def column(self, candidate: Column) -> Column:
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(candidate[node[0]] <= node[1], of(node[2])).otherwise(of(node[3]))

        total = F.lit(float(self.bias))
        for tree in self.trees:
            total = total + of(tree)
        return total

    def passes(self, candidate: Column) -> Column:
        threshold = F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), candidate["generator"] + 1)
        return (candidate["evidence"] == 1) | (self.column(candidate) >= threshold)


def boost(rows: list[tuple[dict[str, int], float, float]], trees: int = 20, depth: int = 3, rate: float = 0.3) -> tuple[float, tuple]:
    """Second-order boosting of logistic loss over counted rows (features, all, confirmed)."""
    everything, positive = sum(r[1] for r in rows), sum(r[2] for r in rows)
    prior = min(max((positive + 0.5) / (everything + 1), 1e-3), 1 - 1e-3)
    bias = math.log(prior / (1 - prior))
    logits, grown = [bias] * len(rows), []
    for _ in range(trees):
        chances = [1 / (1 + math.exp(-x)) for x in logits]
        gradient = [p * n - y for p, (_, n, y) in zip(chances, rows)]
        curvature = [max(p * (1 - p), 1e-6) * n for p, (_, n, _) in zip(chances, rows)]

        def grow(inside: list[int], level: int):
            g, h = sum(gradient[i] for i in inside), sum(curvature[i] for i in inside)
            best = (1e-9, None)
            for name in FEATURES if level else ():
                for cut in sorted({rows[i][0][name] for i in inside})[:-1]:
                    low = [i for i in inside if rows[i][0][name] <= cut]
                    gl, hl = sum(gradient[i] for i in low), sum(curvature[i] for i in low)
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (name, cut))
            if best[1] is None:
                return -rate * g / (h + 1)
            name, cut = best[1]
            low = [i for i in inside if rows[i][0][name] <= cut]
            high = [i for i in inside if rows[i][0][name] > cut]
            return name, cut, grow(low, level - 1), grow(high, level - 1)

        tree = grow(list(range(len(rows))), depth)
        grown.append(tree)
        alone = Model(0.0, (tree,), ())
        logits = [x + alone.score(row[0]) for x, row in zip(logits, rows)]
    return bias, tuple(grown)


def calibrate(bias: float, trees: tuple, rows: list[tuple[dict[str, int], float, float, float]], precision: float) -> tuple[float, ...]:
    """Per generator the lowest score from which on the confirmed share reaches ``precision``.

    Rows hold features, the candidates outside base spans, how many of these
    have evidence, and the candidates that are base spans. Only those outside
    can be added, so they decide; above the first of them the base spans do.
    The score chosen reaches the share by itself too, so that nothing
    unconfirmed rides along below what is confirmed.
    """
    model, thresholds = Model(bias, trees, ()), []
    for generator in range(len(ADDED_KINDS)):
        steps: dict[float, list[float]] = {}
        for features, *counts in rows:
            if features["generator"] == generator:
                step = steps.setdefault(model.score(features), [0.0, 0.0, 0.0])
                step[:] = map(sum, zip(step, counts))
        seen = confirmed = known = 0.0
        chosen = math.inf
        for score in sorted(steps, reverse=True):
            n, y, base = steps[score]
            seen, confirmed, known = seen + n, confirmed + y, known + base
            if seen:
                enough = n and y >= precision * n and confirmed - 1 >= precision * seen
            else:
                enough = known - 1 >= precision * known
            if enough:
                chosen = score
        thresholds.append(chosen)
    return tuple(thresholds)


def fit(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the candidates of all documents by feature combination and boost on the counts.

    The counts have a row per combination, at most a few ten thousand whatever the corpus holds.
    """
    text = whole_text(text_col)
    rows = docs.filter(text.rlike(HINTS)).select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.length(text)), F.lit(2)).alias("half"),
        base_spans(text).alias("base"), candidates(text).alias("proposed"),
    )
    confirmed = F.transform("proposed", lambda c: c.withField(
        "known", F.exists("base", lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])).cast("int")
    ).withField("outside", (~F.exists("base", lambda b: _overlap(b, c))).cast("int")))
    counted = (
        rows.select("half", F.explode(confirmed).alias("c")).select("half", *[f"c.{name}" for name in (*FEATURES, "evidence", "known", "outside")])
        .groupBy("half", *FEATURES).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.greatest("known", "evidence")).alias("y"), F.sum("known").alias("known"),
            F.sum("outside").alias("outside"), F.sum(F.col("outside") * F.col("evidence")).alias("evident"),
        ).collect()
    )
    halves = [sorted((r.asDict() for r in counted if r["half"] == half), key=lambda r: [r[f] for f in FEATURES]) for half in (0, 1)]
    if not halves[0]:
        return Model(0.0, (), (math.inf,) * len(ADDED_KINDS))
    bias, trees = boost([(r, float(r["n"]), float(r["y"])) for r in halves[0]])
    rows = [(r, float(r["outside"]), float(r["evident"]), float(r["known"])) for r in halves[1]]
    return Model(bias, trees, calibrate(bias, trees, rows, precision))


def _overlap(one: Column, other: Column) -> Column:
    return (one["start"] < other["end"]) & (other["start"] < one["end"])


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``base_spans`` and ``all_spans``, arrays of start, rank, end and kind."""
    return _with_spans(docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")), model).select(
        F.col("_id").alias(id_col), F.col("_base").alias("base_spans"), F.col("_all").alias("all_spans")
    )


def _with_spans(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``_base`` and ``_all`` to rows that have ``_text``."""
    none = F.array().cast(f"array<{SPAN}>")
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    scored = rows.withColumn("_proposed", F.when(F.col("_text").rlike(HINTS), candidates(F.col("_text"))))
    passing = F.transform(
        F.filter(F.coalesce("_proposed", F.array().cast(rows_type(scored))), lambda c: ~F.exists("_base", lambda b: _overlap(b, c)) & model.passes(c)),
        lambda c: F.struct(
            (-c["evidence"]).alias("evidence"), (-model.column(c)).alias("score"), c["start"].alias("start"), c["generator"].alias("generator"), c["end"].alias("end")
        ),
    )
    # The best first, each unless it touches one that is taken already.
    scored = scored.withColumn("_passing", F.array_sort(passing))
    added = F.transform(
        F.aggregate("_passing", F.slice("_passing", 1, 0), lambda taken, c: F.when(
            F.exists(taken, lambda o: _overlap(o, c)), taken).otherwise(F.concat(taken, F.array(c)))),
        lambda c: F.struct(
            c["start"].alias("start"), (c["generator"] + len(BASE_KINDS)).alias("rank"), c["end"].alias("end"),
            F.element_at(F.array(*[F.lit(k) for k in ADDED_KINDS]), c["generator"] + 1).alias("kind"),
        ),
    )
    return scored.withColumn("_all", F.array_sort(F.concat("_base", F.coalesce(added.cast(f"array<{SPAN}>"), none)))).drop("_proposed", "_passing")


def rows_type(df: DataFrame) -> str:
    return df.schema["_proposed"].dataType.simpleString()


def as_text(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the first gives the name and all their characters go.
    Other columns may have any names.
    """
    return beside(docs, [text_col], lambda rows: _redacted(rows, model, text_col))


def _redacted(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    rows = _with_spans(docs.withColumn("_text", whole_text(text_col)), model)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        fresh = F.concat(
            so_far["out"], F.substring(F.col("_text"), so_far["at"] + 1, span["start"] - so_far["at"]),
            F.lit("["), F.upper(span["kind"]), F.lit("]"),
        )
        return F.struct(
            F.greatest(so_far["at"], span["end"]).alias("at"),
            F.when(span["start"] >= so_far["at"], fresh).otherwise(so_far["out"]).alias("out"),
        )

    rest = lambda done: F.concat(done["out"], F.substring(F.col("_text"), done["at"] + 1, F.length("_text")))
    redacted = F.when(F.col(text_col).isNotNull(), F.when(F.size("_all") == 0, F.col(text_col)).otherwise(F.aggregate("_all", start, step, rest)))
    return rows.withColumn(text_col, redacted).select(*docs.columns)
