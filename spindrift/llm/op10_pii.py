"""Personal data by fixed patterns, extended by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are the seed entities.  Each seed, and each
other digit-bearing or @-bearing token as an unknown instance, stands in lexical
contexts: the two words before it, and the words at both sides.  Contexts and
instances form a bipartite graph for each kind.  Rounds of DataFrame aggregation
score a context by its seeds of the kind against the instances that contradict it.
Unknown instances of a shape learned from the kind's seeds in a context above the confidence threshold,
with enough distinct seeds behind it, become spans of that kind and seeds of the
next round.

Everything runs in DataFrame expressions.  The patterns are written with
possessive loops, which match as the plain forms do but in linear time and without
recursion on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Same matches as the plain patterns, leftmost and non-overlapping; card holds whole runs of 12 to 19 digits.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind's pattern; cheaper than the pattern.
_NEEDS = {"email": "instr(t, '@') > 0", "ip": r"t RLIKE '[0-9]\\.[0-9]'", "card": r"t RLIKE '[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'", "phone": r"t RLIKE '\\+[0-9]'"}
#: Tokens with a digit or an @, the unknown instances.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A run of tokens of digits with few other signs, as spaced numbers are, is one instance.
_NUMBERS = r"(?<![^\x20\x09-\x0D])[(+]*+[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++(?=[\x20\x09-\x0D\"'`)\]<>,;:.!?]|$)"
_TOKENS = rf"{_NUMBERS}[^\x20\x09-\x0D]*+|{_TOKEN}"
_EDGE = r"[\"'`(){}\[\]<>,;:.!?|*#$%&=]"
_SPAN = "array<struct<start:int,ord:int,`end`:int>>"
#: Characters beside an instance that are looked at first; where they cut a word, more are, at last all.
_WINDOWS = (64, 2048)
_WORD, _GAP = "[^\\\\x20\\\\x09-\\\\x0D]", "[\\\\x20\\\\x09-\\\\x0D]"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _located(pattern: str, each: str, kind: str) -> str:
    """SQL: array of ``each`` (a struct of match ``m`` and its offset ``p``) for the pattern's matches in ``t``.

    What split leaves between matches gives their offsets.
    """
    step = f"(a, i) -> struct(a.p + length(g[i]) + length(get(x, i)) AS p, array_append(a.o, {_bind('struct(get(x, i) AS m, a.p + length(g[i]) AS p)', 'e', each)}) AS o)"
    walk = f"aggregate(sequence(0, size(x) - 1), struct(0 AS p, cast(array() AS {kind}) AS o), {step}, a -> a.o)"
    found = _bind(f"split(t, {_lit(pattern)}, -1)", "g", walk)
    return _bind(f"regexp_extract_all(t, {_lit(pattern)}, 0)", "x", f"CASE WHEN size(x) = 0 THEN cast(array() AS {kind}) ELSE {found} END")


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        # a part of over three digits after its leading zeros is over 255
        part = "length(ltrim('0', q)) <= 3 AND cast(concat('0', right(ltrim('0', q), 3)) AS int) <= 255"
        return f"forall(split({m}, '\\\\.', -1), q -> {part})"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "card":
        # doubling a digit of 5 and up counts its two figures' sum
        digit = "cast(substring(d, length(d) - i, 1) AS int)"
        luhn = f"aggregate(sequence(0, length(d) - 1), 0L, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {digit} ELSE (2 * {digit}) % 10 + (2 * {digit}) DIV 10 END) % 10 = 0"
        return _bind(digits, "d", f"(length(d) BETWEEN 12 AND 19 AND {luhn})")
    return "true"


def _base_sql() -> str:
    """SQL over ``t``: base spans by start, then kind."""
    parts = []
    for order, kind in enumerate(KINDS):
        each = f"CASE WHEN {_valid(kind, 'e.m')} THEN struct(e.p AS start, {order} AS ord, e.p + length(e.m) AS `end`) END"
        found = f"filter({_located(PATTERNS[kind], each, _SPAN)}, s -> s IS NOT NULL)"
        parts.append(f"CASE WHEN {_NEEDS[kind]} THEN {found} ELSE cast(array() AS {_SPAN}) END")
    return f"sort_array(concat({', '.join(parts)}))"


def _tokens_sql() -> str:
    """SQL over ``t`` and base spans ``b``: digit- or @-bearing tokens without edge punctuation, off the base spans."""
    lead = f"length(e.m) - length(regexp_replace(e.m, {_lit('^' + _EDGE + '++')}, ''))"
    core = f"regexp_replace(regexp_replace(e.m, {_lit('^' + _EDGE + '++')}, ''), {_lit(_EDGE + '++$')}, '')"
    each = f"struct(e.p + {lead} AS start, -1 AS ord, e.p + {lead} + length({core}) AS `end`)"
    found = _located(_TOKENS, each, _SPAN)
    free = f"filter({found}, s -> s.`end` > s.start AND NOT exists(b, o -> o.start < s.`end` AND s.start < o.`end`))"
    return f"CASE WHEN t RLIKE '[0-9@]' THEN {free} ELSE cast(array() AS {_SPAN}) END"


def _left_words() -> str:
    """SQL over ``t`` and span ``s``: the words before the span, the last two of them whole."""
    words = lambda part: f"regexp_extract_all(lower({part}), '{_WORD}++', 0)"
    out = words("substring(t, 1, s.start)")
    for n in reversed(_WINDOWS):
        # a window that does not reach the text's start may cut its first word
        out = f"CASE WHEN s.start <= {n} THEN {words('substring(t, 1, s.start)')} ELSE {_bind(words(f'substring(t, s.start - {n} + 1, {n})'), f'w{n}', f'CASE WHEN size(w{n}) > 2 THEN w{n} ELSE {out} END')} END"
    return out


def _right_word() -> str:
    """SQL over ``t`` and span ``s``: the word after the one that the span ends in, whole."""
    rest = lambda n: f"lower(substring(t, s.`end` + 1{n}))"
    found = lambda part, end: f"regexp_extract({part}, '^{_WORD}*+{_GAP}++({_WORD}++){end}', 1)"
    out = found(rest(""), "")
    for n in reversed(_WINDOWS):
        out = f"CASE WHEN s.`end` + {n} >= length(t) THEN {found(rest(''), '')} ELSE {_bind(found(rest(f', {n}'), _GAP), f'r{n}', f"CASE WHEN r{n} <> '' THEN r{n} ELSE {out} END")} END"
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, tokens): base spans and unknown instances with their contexts.

    A null text counts as empty.  ``digest`` tells apart rows that share a doc_id.
    """
    t = "coalesce(cast(text AS string), '')"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(t).alias("t")).withColumn("digest", F.xxhash64("t"))
    spans = base.select("doc_id", "digest", "t", F.expr(_base_sql()).alias("b"))
    left, right = _left_words(), _right_word()
    shown = _bind(left, "l", f"struct(s.start AS start, s.ord AS ord, s.`end` AS `end`, substring(t, s.start + 1, s.`end` - s.start) AS inst, coalesce(try_element_at(l, -2), '') AS l2, coalesce(try_element_at(l, -1), '') AS l1, {right} AS r1)")
    return spans.select("doc_id", "digest", "b", F.expr(f"transform(concat(b, {_tokens_sql()}), s -> {shown})").alias("seen"))


def discover(scanned: DataFrame, rounds: int = 20, min_seeds: int = 4, confidence: float = 0.85) -> DataFrame:
    """Spans (doc_id, digest, start, ord, end) of unknown instances in high-confidence contexts.

    ``scanned`` is a table as ``scan`` makes, written and read again.  A context is
    usable for a kind with ``min_seeds`` distinct seeds of it; its score is
    (seeds + 1) / (seeds + contradicting instances + 1), where seeds of other kinds
    and unknown instances without the shape of the kind's seeds contradict and other
    unknown ones do not count.  Unknown instances of the shape in contexts of at least
    ``confidence`` become seeds of the next round, whose contexts are counted anew;
    rounds end when none is found.
    """
    occ = scanned.select("doc_id", "digest", F.explode("seen").alias("s")).select("doc_id", "digest", "s.*")
    contexts = F.explode(F.array(F.concat_ws("\x01", F.lit("L"), "l2", "l1"), F.concat_ws("\x01", F.lit("M"), "l1", "r1"))).alias("ctx")
    placed = occ.where("l1 <> ''").select("doc_id", "digest", "start", "ord", "end", "inst", contexts)
    # an instance string is of a kind if any of its occurrences is; distinct pairs are combined before the shuffle
    kinds = occ.groupBy("inst").agg(F.max("ord").alias("seed"))
    pairs = placed.groupBy("ctx", "inst").agg(F.max("ord").alias("ord")).select("ctx", "inst")
    kinds, _ = materialize(kinds, "pii-kinds")
    digits = F.length(F.regexp_replace("inst", "[^0-9]", "")).alias("digits")
    graph, _ = materialize(pairs.join(kinds, "inst").select("ctx", "inst", "seed", digits, F.col("inst").contains("@").alias("at"), F.col("inst").contains(".").alias("dot")), "pii-graph")
    # at most a row for each kind
    learned = {r["seed"]: r for r in graph.where("seed >= 0").groupBy("seed").agg(F.min("digits").alias("least"), F.max("digits").alias("most"), F.bool_and("at").alias("at"), F.bool_and("dot").alias("dot")).collect()}
    shaped = {k: _shape(learned[k]) if k in learned else F.lit(False) for k in range(len(KINDS))}
    believed = None
    strong = None
    before = 0
    for _ in range(rounds):
        now = graph.withColumn("kind", F.col("seed")) if believed is None else graph.join(believed, "inst", "left").withColumn("kind", F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.coalesce("found", F.lit(-1))))
        sums = [c for k in shaped for c in (F.count(F.when(F.col("kind") == k, 1)).alias(f"s{k}"), F.count(F.when((F.col("kind") < 0) & ~shaped[k], 1)).alias(f"odd{k}"))]
        counted = now.groupBy("ctx").agg(*sums, F.count(F.when(F.col("kind") >= 0, 1)).alias("all"))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.col(f"s{k}").alias("n"), F.col(f"odd{k}").alias("odd")) for k in shaped)))
        rated = counted.select("ctx", "all", each.alias("e")).where(F.col("e.n") >= min_seeds).select("ctx", "e.ord", ((F.col("e.n") + 1) / (F.col("all") + F.col("e.odd") + 1)).alias("c"))
        strong, _ = materialize(rated.where(F.col("c") >= confidence), "pii-contexts")
        fits = F.coalesce(*(F.when(F.col("ord") == k, shaped[k]) for k in shaped))
        believed, _ = materialize(graph.where("seed < 0").join(strong, "ctx").where(fits).groupBy("inst").agg(F.max_by("ord", F.struct("c", -F.col("ord"))).alias("found")), "pii-believed")
        after = believed.count()
        if after == before:
            break
        before = after
    if strong is None:
        raise ValueError("at least one round is needed")
    unseen = placed.where("ord < 0").select("doc_id", "digest", "start", "end", "inst", "ctx", digits, F.col("inst").contains("@").alias("at"), F.col("inst").contains(".").alias("dot"))
    best = unseen.join(strong, "ctx").where(F.coalesce(*(F.when(F.col("ord") == k, shaped[k]) for k in shaped))).groupBy("doc_id", "digest", "start", "end").agg(F.max_by("ord", F.struct("c", -F.col("ord"))).alias("ord"))
    return best.select("doc_id", "digest", "start", "ord", "end")


def _shape(seen: Row) -> Column:
    """Whether an instance (digits, at, dot) looks like a kind's seeds: the signs that all of them have, and from half of their fewest digits to twice their most."""
    signs = [F.col(c) for c in ("at", "dot") if seen[c]]
    fits = F.lit(True) if seen["at"] else F.col("digits").between(-(-seen["least"] // 2), 2 * seen["most"]) & ~F.col("at")
    for sign in signs:
        fits = fits & sign
    return fits


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, digest, base, spans) of every row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` are arrays of (start, ord, end) in code points, ``ord``
    an index of KINDS; spans holds all of base.  Null or empty texts have none;
    repeated rows get equal spans, each row its own; of kinds that fit alike the better
    context's counts, then the first in KINDS; a text of any length is scanned whole; an
    empty table gives no rows; other columns are ignored.
    """
    scanned, _ = materialize(scan(docs), "pii-scan")
    more = discover(scanned, **options).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_list(F.struct("start", "ord", "end")).alias("more"))
    held = scanned.join(more, scanned["doc_id"].eqNullSafe(more["__id"]) & (scanned["digest"] == more["__digest"]), "left")
    return held.select("doc_id", "digest", F.col("b").alias("base"), F.expr(f"sort_array(concat(b, coalesce(more, cast(array() AS {_SPAN}))))").alias("spans"))


def _named(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.ord], ':', s.start, ':', s.`end`)), ',')")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets, n_chars following the text.

    Columns are those of ``docs``; of overlapping spans the first stays.  A null
    text stays null.
    """
    # packed, so that no column of docs can clash with one of the join
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    found = find_spans(docs.select("doc_id", "text"), **options).where(F.size("spans") > 0)
    spans = found.select(F.col("doc_id").alias("span_key"), F.col("digest").alias("span_digest"), "spans").dropDuplicates(["span_key", "span_digest"])
    joined = rows.join(spans, rows["key"].eqNullSafe(spans["span_key"]) & (rows["digest"] == spans["span_digest"]), "left")
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    step = f"(a, s) -> CASE WHEN s.start < a.at THEN a ELSE struct(s.`end` AS at, array_append(a.o, concat(substring(doc.text, a.at + 1, s.start - a.at), {names}[s.ord])) AS o) END"
    walk = f"aggregate(spans, struct(0 AS at, cast(array() AS array<string>) AS o), {step}, a -> concat(array_join(a.o, ''), substring(doc.text, a.at + 1)))"
    shown = joined.select("doc", "spans", F.expr(f"CASE WHEN spans IS NULL OR doc.text IS NULL THEN doc.text ELSE {walk} END").alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return shown.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.ord = {order})) AS bigint)").alias(f"n_{kind}") for order, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named("base"), 256).alias("base_sha256"), _named("spans").alias("spans"))
