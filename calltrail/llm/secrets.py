"""Operator 4, secret scans: rules, and character Markov models.  DataFrame
functions only.

Three base rules give spans (`assign`, `access`, `hex`).  The method adds spans
of kind `markov`: long tokens whose characters are likelier under a first-order
Markov model of random strings than under one of ordinary identifiers.  Both
models are bigram counts of labelled samples: values that the base rules found
(random) and the other tokens of a document sample (ordinary).

Positions come from the text itself: every match is put between marks, the
marked text is split at them, and the lengths of the parts add up to starts and
ends.  Spans are blanked in a copy of the text of the same length; candidates
are looked for in that copy, so the rest of a token that a base span cuts is
judged on its own, and redaction replaces the copy's blanks.  All steps are
linear in the text and its spans.  Mark and blank are two noncharacters of
Unicode, which no rule can match; where a text holds them, they are taken as a
third one first, so positions do not move (a redacted text keeps the third one).
"""

from __future__ import annotations

from collections import defaultdict
from math import log

from pyspark.sql import Column, DataFrame, functions as F

# The base rules, in the order in which spans of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]
#: Shortest value of an assignment, access key, hex run.
LEAST = {"assign": 12, "access": 18, "hex": 16}

_CLASS = "[A-Za-z0-9+/_=-]"
#: Tokens that the models judge, and tokens that the ordinary model learns from.
CANDIDATE = rf"(?<!{_CLASS}){_CLASS}{{20,}}"
ORDINARY = rf"(?<!{_CLASS}){_CLASS}{{6,}}"
#: Labelled samples: random values, and documents with ordinary tokens, at most.
MAX_RANDOM, MAX_DOCUMENTS = 5_000, 500
#: A token is a secret if its log-likelihood ratio is at least this much per transition.
THRESHOLD = 0.5
_MARK, _BLANK, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"
#: Parts of a text walked in one fold (an even number): a step copies what its fold has gathered.
_BLOCK = 64


def clean(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), F.lit(_BLANK), F.lit(_OTHER))


def parts_of(text: Column, pattern: str) -> Column:
    """The text cut at the matches of `pattern`, which are every second part."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def found(text: Column, pattern: str, ok) -> Column:
    """Leftmost non-overlapping matches that satisfy `ok`, as an array of
    (start, end, part); code points, end exclusive."""
    kind = "array<struct<start:int,end:int,part:string>>"

    def step(acc, part):
        to = acc["at"] + F.char_length(part)
        one = F.array(F.struct(acc["at"].alias("start"), to.alias("end"), part.alias("part")))
        return F.struct(to.alias("at"), (~acc["hit"]).alias("hit"),
                        F.when(acc["hit"] & ok(part), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of_block(block, at):
        start = F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(kind).alias("out"))
        return F.aggregate(block, start, step, lambda a: a["out"])

    def border(acc, block):
        length = F.aggregate(block, F.lit(0), lambda n, part: n + F.char_length(part))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def cut(parts):
        last = F.floor((F.size(parts) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * _BLOCK + 1, _BLOCK))

    def spans(blocks):
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, first, border, lambda a: a["out"]), of_block))

    return F.when(text.rlike(pattern), _let(_let(parts_of(text, pattern), cut), spans)).otherwise(F.array().cast(kind))


def blanked(text: Column, pattern: str, ok) -> Column:
    """The text with the matches that satisfy `ok` blanked, as long as before."""
    def step(part, i):
        return F.when((i % 2 == 1) & ok(part), F.repeat(F.lit(_BLANK), F.char_length(part))).otherwise(part)

    return F.when(text.rlike(pattern), F.array_join(F.transform(parts_of(text, pattern), step), "")).otherwise(text)


def _both(a: Column, b: Column, t: Column) -> Column:
    """Blanks of either of two copies of `t`."""
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == _BLANK, x).otherwise(y))
    return F.when(a == t, b).when(b == t, a).otherwise(F.array_join(letters, ""))


# The base rules: pattern, and what its matches must satisfy.  A hex run is only
# looked at if it is long enough: the runs are greedy, so this is the same.
RULES = {
    "assign": (ASSIGN, lambda p: F.char_length(F.regexp_extract(p, ASSIGN, 2)) >= LEAST["assign"]),
    "access": (ACCESS, lambda p: F.char_length(p) >= LEAST["access"]),
    "hex": (HEX[:-1] + f"{{{LEAST['hex']},}}", lambda p: F.lit(True)),
}


def base_spans(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """`others`, doc_id, t (the text as scanned) and the spans of each base rule."""
    t = F.col("t")
    return docs.select(*others, F.col("doc_id").cast("long").alias("doc_id"), clean(F.col("text")).alias("t")).select(
        *others, "doc_id", "t", *[found(t, pattern, ok).alias(kind) for kind, (pattern, ok) in RULES.items()])


def _bigrams(tokens: DataFrame) -> DataFrame:
    """Counts of adjacent characters: (label, c, d, n); tokens: (label, token)."""
    pairs = tokens.select("label", F.explode(F.expr(
        "transform(sequence(1, char_length(token) - 1), i -> substring(token, i, 2))")).alias("p"))
    return (pairs.groupBy("label", "p").count()
            .select("label", F.ascii("p").alias("c"), F.ascii(F.substring("p", 2, 1)).alias("d"), "count"))


def train(docs: DataFrame, max_random: int = MAX_RANDOM, max_documents: int = MAX_DOCUMENTS) -> list[float]:
    """Log-likelihood ratios random : ordinary of character d after c, at 128 c + d.

    Random strings: the values of base spans, at most `max_random`.  Ordinary
    ones: tokens of six characters and more outside base spans that stand in two
    texts or more (an unlisted secret seldom does), of at most `max_documents`
    different texts.  Both are those with the smallest hash, so the models
    are the same on every run.  Transitions are
    smoothed by the frequency of the character itself, as if seen ten times
    more; without samples all ratios are 0 and nothing is added.
    """
    spans = base_spans(docs)
    # an assignment's value, and the keys; a run of decimal digits is a number more often than a secret
    values = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["part"], ASSIGN, 2)),
                      F.transform("access", lambda s: s["part"]),
                      F.filter(F.transform("hex", lambda s: s["part"]), lambda p: p.rlike("[a-f]")))
    random = (spans.select(F.explode(values).alias("token")).where(F.col("token").rlike(rf"^{_CLASS}{{2,}}$"))
              .orderBy(F.xxhash64("token"), "token").limit(max_random).select(F.lit(1).alias("label"), "token"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), "[0-9a-f]{16,}", " ")
    # the hashes alone are sorted; texts travel only for the few that are picked
    hashed = docs.select("text", F.xxhash64("text").alias("d"))
    picked = [r["d"] for r in hashed.select("d").distinct().orderBy("d").limit(max_documents).collect()]
    ordinary = (hashed.where(F.col("d").isin(picked)).groupBy("d").agg(F.min(clean(F.col("text"))).alias("t"))
                .select("d", F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("token"))
                .distinct().groupBy("token").count().where("count > 1").select(F.lit(0).alias("label"), "token"))
    # at most 2 x 65 x 65 rows, whatever the input
    counts = _bigrams(random.union(ordinary)).collect()
    n, after, total = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in counts:
        n[r["label"], r["c"], r["d"]] += r["count"]
        after[r["label"], r["c"]] += r["count"]
        n[r["label"], r["d"]] += r["count"]
        total[r["label"]] += r["count"]
    if {r["label"] for r in counts} != {0, 1}:
        return [0.0] * (128 * 128)
    one = lambda k, d: (n[k, d] + 1) / (total[k] + 65)
    p = lambda k, c, d: (n[k, c, d] + 10 * one(k, d)) / (after[k, c] + 10)
    return [log(p(1, c, d) / p(0, c, d)) for c in range(128) for d in range(128)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")  # folded to one literal
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))

    def steps(codes):
        return F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0),
                           lambda a, i: a + F.get(table, F.get(codes, i - 1) * 128 + F.get(codes, i)))

    return F.aggregate(F.array(codes), F.lit(0.0), lambda a, c: a + steps(c) / (F.size(c) - 1))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, others: tuple[str, ...] = ()) -> DataFrame:
    """`others` (columns to carry along), doc_id, t, `left`, and `spans`: all spans as an array of (start, kind no., end),
    sorted.  Null texts are empty; an empty text has no spans.

    A markov span is a token of 20 characters or more, or what base spans leave
    of one, whose mean ratio reaches the threshold; it overlaps no base span.
    `left` is t with all spans blanked.
    """
    t = F.col("t")
    based = base_spans(docs, others)
    for kind, (pattern, ok) in RULES.items():
        based = based.withColumn(f"without_{kind}", F.when(F.size(kind) > 0, blanked(t, pattern, ok)).otherwise(t))
    based = based.withColumn("keys", _both(F.col("without_access"), F.col("without_hex"), t))
    based = based.withColumn("rest", _both(F.col("without_assign"), F.col("keys"), t))
    likely = lambda p: ratio(p, model) >= threshold
    based = based.withColumn("likely", found(F.col("rest"), CANDIDATE, likely))
    left = F.when(F.size("likely") > 0, blanked(F.col("rest"), CANDIDATE, likely)).otherwise(F.col("rest"))

    def listed(col, k):
        return F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    return based.select(*others, "doc_id", "t", F.array_sort(F.concat(
        listed("assign", 0), listed("access", 1), listed("hex", 2), listed("likely", 3))).alias("spans"),
        left.alias("left"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (text)."""
    s = scan(docs, model)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    n(3).alias("n_markov"),
                    F.sha2(told(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
                    told(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: list[float], by: str = "[SECRET]") -> DataFrame:
    """docs with its columns, every span of `text` replaced (spans that overlap
    or touch as one); a null text stays null, and a text without spans stays as it is."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # safe names: a table may hold clashing ones
    text = F.col(names[docs.columns.index("text")])
    plain = docs.toDF(*names).select("*", F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    s = scan(plain, model, others=tuple(names))
    plain_by = by.replace("\\", "\\\\").replace("$", "\\$")  # the two characters that a replacement escapes
    new = F.when(F.col("left") != F.col("t"), F.regexp_replace("left", f"{_BLANK}+", plain_by)).otherwise(text)
    return s.select(*[new.alias(c) if n == "text" else F.col(c) for c, n in zip(names, docs.columns)]).toDF(*docs.columns)
