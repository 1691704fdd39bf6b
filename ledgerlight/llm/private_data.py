"""Personal data by patterns and by bootstrapped context, in DataFrame functions only.

Four kinds have a base form: mail addresses, IP addresses, card numbers and phone numbers. Their
matches are the seeds. Identifiers that have the shape of a kind but not its base form (a national
phone number, an address written with "at", an IPv6 address) are candidates. Words around a mention
are its patterns. Patterns and mentions form a graph, which is scored in rounds: a pattern
by the share of its mentions that belong to one kind, a candidate by the patterns of that kind it
stands in; a believed candidate counts as a mention of its kind in the next round. Candidates that end
with a high score are personal data wherever they occur.

Seeds of other kinds count against a pattern in full and unknown candidates in part, and a pattern needs
many different mentions. So a word that only happens to stand before identifiers discovers nothing.

Every regular expression scans a text once: runs are possessive and begin only where one can begin,
so time is linear in the text and nothing recurses. A text is marked, split at the marks and reduced to
the matches, the lengths of the gaps and the words next to them; positions are running sums over
those small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import scratch

#: The kinds in their order, and their base forms.
KINDS = ("email", "ip", "card", "phone")
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: Shapes of candidates: an address with @, one with (at), groups of hexadecimal digits, groups of digits.
_NAME = r"[^\s@<>\"'(),;:\[\]"
MAIL_SHAPE = rf"(?<!{_NAME}]){_NAME}]++@{_NAME}]*{_NAME}.!?]"
SPELT_SHAPE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)*+"
HEX_SHAPE = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}+(?![0-9A-Za-z:])"
DIGIT_SHAPE = r"(?<![0-9A-Za-z._%+@-])[(]?[0-9](?:[ ()./-]{0,2}+[0-9])++(?![0-9A-Za-z@])"
CANDIDATE = "|".join((MAIL_SHAPE, SPELT_SHAPE, HEX_SHAPE, DIGIT_SHAPE))
_OTHER = len(KINDS)
_MARK = "\x01"
#: Characters of context that are kept on either side.
CONTEXT = 40
#: A pattern's or candidate's score from which it is believed.
LEAST_SCORE = 0.8
#: Different mentions of its kind that a pattern needs.
LEAST_MENTIONS = 8
#: What an unknown candidate counts against a pattern.
UNKNOWN_WEIGHT = 0.25
ROUNDS = 3


def _pieces(text: Column, kind: int, pattern: str) -> Column:
    """The text cut at its matches: odd places are matches, even ones the gaps, of which only the ends are kept."""
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}"))

    def piece(p: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.char_length(p).alias("size"), F.when(i % 2 == 1, p).alias("hit"),
            F.when(i % 2 == 0, F.left(p, F.lit(CONTEXT))).alias("head"), F.when(i % 2 == 0, F.right(p, F.lit(CONTEXT))).alias("tail"),
        )

    return F.transform(F.split(marked, _MARK, -1), piece)


def _found(text: Column) -> Column:
    """The pieces of every kind that the text can hold at all."""
    none = F.filter(_pieces(F.lit(""), 0, "x"), lambda p: F.lit(False))
    digit = text.rlike("[0-9]")
    able = [F.contains(text, F.lit("@")), digit, digit, F.contains(text, F.lit("+")), digit | text.rlike(r"@|[(\[]at[)\]]")]
    return F.concat(*(F.when(can, _pieces(text, k, p)).otherwise(none) for k, (can, p) in enumerate(zip(able, (*BASE, CANDIDATE)))))


def _valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a base form is one: octets, digits, check digit."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
    return (
        F.when(kind == 0, True)
        .when(kind == 1, hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == 2, F.char_length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", F.left(digits, F.lit(19))), F.lit(False)))
        .when(kind == 3, F.char_length(digits).between(10, 15))
    )


def _shapes(hit: Column) -> Column:
    """The kinds a candidate can be, by its shape."""
    n = F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
    mail, digits = hit.rlike(r"@|[(\[]at[)\]]"), hit.rlike(rf"^{DIGIT_SHAPE}$")
    can = [mail, ~mail & ~digits & (n > 0), ~mail & digits & n.between(12, 19), ~mail & digits & n.between(7, 15)]
    return F.filter(F.array(*(F.when(c, k) for k, c in enumerate(can))), lambda k: k.isNotNull())


def _mentions(stored: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit, before, after): valid base matches, and candidates (kind 4) that overlap none."""
    pieces = stored.select("row", F.explode("found").alias("p")).select("row", "p.*")
    along = Window.partitionBy("row", "kind").orderBy("place")
    side = lambda name, by: F.coalesce(F.lag(name, by).over(along), F.lit(""))
    hits = pieces.select(
        "row", "kind", "hit", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), "size",
        F.right(F.concat(side("hit", 2), side("tail", 1)), F.lit(CONTEXT)).alias("before"), F.left(F.concat(side("head", -1), side("hit", -2)), F.lit(CONTEXT)).alias("after"),
    ).where("hit is not null")
    hits = hits.where((F.col("kind") == _OTHER) | _valid(F.col("kind"), F.col("hit"))).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind") < _OTHER
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # in linear time, unlike rows up to the end
    free = hits.select("*", F.max(F.when(base, F.col("end"))).over(earlier).alias("till"), F.min(F.when(base, F.col("start"))).over(later).alias("next"))
    apart = (F.coalesce("till", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return free.where(base | (apart & (F.size(_shapes(F.col("hit"))) > 0))).select("row", "kind", "start", "end", "hit", "before", "after")


def _patterns(before: Column, after: Column) -> Column:
    """The words around a mention, digits as 0: one or two before it, or one before and one after."""
    token = F.lit(r"[\p{L}0]+|[^\s\p{L}0]")
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    left, right = F.regexp_extract_all(plain(before), token, 0), F.regexp_extract_all(plain(after), token, 0)
    first = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^"))
    second = F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^"))
    follow = F.coalesce(F.try_element_at(right, F.lit(1)), F.lit("$"))
    return F.array(F.concat(first, F.lit(" _")), F.concat(second, F.lit(" "), first, F.lit(" _")), F.concat(first, F.lit(" _ "), follow))


def _believed(edges: DataFrame, rounds: int, least_score: float, least_mentions: int) -> DataFrame:
    """(hit, kind, score) of candidates believed after the last round; ``edges`` are distinct (pattern, kind, hit)."""
    unknown = scratch.keep(edges.where(F.col("kind") == _OTHER).select("pattern", "hit"), "pii-unknown")
    known = scratch.keep(
        edges.join(unknown.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(*(F.count_if(F.col("kind") == k).alias(f"seed{k}") for k in range(_OTHER)), F.count_if(F.col("kind") == _OTHER).alias("open")),
        "pii-patterns",
    )
    scores = unknown.select("hit", F.lit(0).alias("kind"), F.lit(0.0).alias("score")).where(F.lit(False))
    for _ in range(rounds):
        gained = unknown.join(scores, "hit").groupBy("pattern").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"gain{k}") for k in range(_OTHER)))
        own = [F.col(f"seed{k}") + F.coalesce(f"gain{k}", F.lit(0.0)) for k in range(_OTHER)]
        total = sum(own[1:], own[0])
        doubt = (F.col("open") - (total - sum((F.col(f"seed{k}") for k in range(1, _OTHER)), F.col("seed0")))) * UNKNOWN_WEIGHT
        rated = known.join(gained, "pattern", "left").select("pattern", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), own[k].alias("own"), F.round(own[k] / (total + doubt + 1), 9).alias("score")) for k in range(_OTHER)))).alias("r"))
        good = scratch.keep(rated.select("pattern", "r.*").where((F.col("score") >= least_score) & (F.col("own") >= least_mentions)), "pii-good")
        fits = unknown.join(good, "pattern").where(F.array_contains(_shapes(F.col("hit")), F.col("kind")))
        # several patterns of one kind: the chance that all of them are wrong
        scored = fits.groupBy("hit", "kind").agg(F.round(1 - F.product(1 - F.col("score")), 9).alias("score"))
        best = scored.groupBy("hit").agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("b"))
        scores = scratch.keep(best.select("hit", (-F.col("b.order")).alias("kind"), F.col("b.score").alias("score")), "pii-scores")
    return scores.where(F.col("score") >= least_score)


def find_private_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
    rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_mentions: int = LEAST_MENTIONS,
) -> DataFrame:
    """(doc_id, ..., base, spans) per row: arrays of (start, kind number, end), ordered.

    Positions are code points from 0, ends exclusive. ``base`` holds the valid base matches, ``spans``
    also the discovered ones, which overlap no base match. Each row is its own text, ids may be null or
    repeated; null and empty texts have no spans; equal mentions count once as evidence, however often
    a text was copied. Columns of ``carry`` are returned, others are not read. Without rows, no rows.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, "\x02")
    stored = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.col(doc_id).alias("doc_id"), *carry).alias("given"), _found(clean).alias("found")), "pii-pieces")
    mentions = scratch.keep(_mentions(stored), "pii-mentions")
    evidence = mentions.select("kind", F.lower("hit").alias("hit"), F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"))
    edges = scratch.keep(evidence.select("pattern", "kind", "hit").distinct(), "pii-edges")
    believed = _believed(edges, rounds, least_score, least_mentions)
    base = mentions.where(F.col("kind") < _OTHER).select("row", "start", "kind", "end", F.lit(True).alias("seed"))
    fresh = mentions.where(F.col("kind") == _OTHER).select("row", "start", "end", F.lower("hit").alias("hit")).join(believed.select("hit", "kind"), "hit")
    every = base.unionByName(fresh.select("row", "start", "kind", "end", F.lit(False).alias("seed")))
    span = F.struct("start", "kind", "end")
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("seed"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    whole = stored.select("row", "given").join(spans, "row", "left")
    return whole.select("given.*", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    """The number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
