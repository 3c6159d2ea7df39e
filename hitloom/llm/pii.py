"""Personal data: fixed forms, and more of them found by the contexts that they stand in.

Emails, IP addresses, card and phone numbers of a fixed form are the seeds. The words on both sides of a
seed, and two words before it that end as a label, are its patterns. Patterns and the strings seen in them make a graph, scored in rounds: a pattern is as
good as the strings that it holds, a string as likely as its patterns say together. Strings with digits
or at signs that good patterns hold are found too, with the kind of the seeds there, and bring patterns of
their own to the next round. Secrets (passwords, access tokens) have seeds but no fixed form: they are
assigned strings of many hex digits, and only what good patterns hold is reported. SQL functions only.

Positions come from the text between matches: a match starts after all gaps and matches before it. The
expressions start at the head of a run only and do not give back characters, so they take linear time;
dots and separators inside a run are first marked by one private character, so no group is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import dropped, numbered, written

KINDS = ("email", "ip", "card", "phone")
#: Found by contexts only: no fixed form of it is reported, its seeds are assigned strings of many hex digits.
SECRET = "secret"
ALL = (*KINDS, SECRET)

# The marker of inner dots and separators, its stand-in where texts hold it, and the forms.
MARK, STAND_IN = "", ""
INNER_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
INNER_BLANK = r"(?<=[0-9])[\x20-](?=[0-9])"
CARD = rf"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET_SEED = r"^[0-9A-Fa-f]{32,}$"
#: The end of a word that says what follows, as in `token =` and `phone:`.
LABEL = r"[=:]$"
#: Quotes next to a string are no words.
OPENED, CLOSED = "[\"'`]\\z", "^[\"'`]"
#: Other strings that may be identifiers: words with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Marks around such a word are not part of the string; a plus before it is, as in phone numbers.
HEAD_MARKS, TAIL_MARKS = r"^[\p{P}\p{S}&&[^+]]++", r"(?<![\p{P}\p{S}])[\p{P}\p{S}]++$"
#: Code points of context that count on either side (two words, of which the far end of very long ones is left out), code points of a piece of text.
NEAR_TEXT, PIECE = 160, 256
#: The word before the first and after the last one; no word holds a blank.
EDGE = " "

#: Rounds of scoring, seeds that a pattern holds at least, and scores from which patterns and strings count.
ROUNDS, SUPPORT, GOOD_PATTERN, GOOD_STRING = 3, 3, 0.7, 0.9
#: What a string that nothing is known of takes from a pattern, beside what a seed gives: it may be an unseen identifier.
UNKNOWN = 0.25

SPAN = "array<struct<s:int,e:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, form: str) -> Column:
    """All matches with their places (code points) and strings."""
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        def walk(gaps: Column) -> Column:
            def step(done: Column, i: Column) -> Column:
                s = done["at"] + F.char_length(F.get(gaps, i))
                e = s + F.char_length(F.get(hits, i))
                row = F.struct(s.alias("s"), e.alias("e"), F.get(hits, i).alias("value"))
                return F.struct(F.concat(done["rows"], F.array(row)).cast(SPAN).alias("rows"), e.alias("at"))

            start = F.struct(none.alias("rows"), F.lit(0).alias("at"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda done: done["rows"])

        return F.when(F.size(hits) > 0, _let(F.split(text, form, -1), walk)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), placed)


def _trimmed(x: Column) -> Column:
    """The span without the marks at its edges."""
    head, tail = (F.char_length(F.regexp_extract(x["value"], marks, 0)) for marks in (HEAD_MARKS, TAIL_MARKS))
    s, e = x["s"] + head, x["e"] - tail
    return F.struct(s.alias("s"), e.alias("e"), F.substring(x["value"], head + 1, e - s).alias("value"))


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s++", " ")


def _around(text: Column) -> Column:
    """The text in pieces, with the end of all that is before each piece and the beginning of all after it.

    A word is then found in one piece, wherever it is in the text, and however long the blanks are.
    """

    def ends(pieces: Column, before: bool) -> Column:
        def step(done: Column, piece: Column) -> Column:
            near = _single_blanks(F.concat(done["near"], piece) if before else F.concat(piece, done["near"]))
            near = F.substring(near, -NEAR_TEXT - 1, NEAR_TEXT + 1) if before else F.substring(near, 1, NEAR_TEXT + 1)
            return F.struct(F.concat(done["all"], F.array(done["near"])).alias("all"), near.alias("near"))

        start = F.struct(F.array().cast("array<string>").alias("all"), F.lit("").alias("near"))
        return F.aggregate(pieces if before else F.reverse(pieces), start, step, lambda done: done["all"] if before else F.reverse(done["all"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(pieces, lambda p: F.struct(p.alias("pieces"), ends(p, True).alias("before"), ends(p, False).alias("after")))


def _with_words(spans: Column, around: Column) -> Column:
    """Spans with the two words before and after in the whole text, in lower case, digits as 0."""

    def at(name: str, place: Column) -> Column:
        return F.coalesce(F.get(around[name], F.floor(place / PIECE).cast("int")), F.lit(""))

    def words(near: Column, before: bool) -> Column:
        """The two nearest words, nearest first; a quote that the string stands in is none."""
        near = F.regexp_replace(near, OPENED if before else CLOSED, "")
        near = F.regexp_replace(F.lower(F.trim(_single_blanks(near))), "[0-9]", "0")
        near = F.substring(near, -NEAR_TEXT, NEAR_TEXT) if before else F.substring(near, 1, NEAR_TEXT)
        parts = F.split(near, " ")
        parts = F.reverse(parts) if before else parts
        return F.transform(F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), lambda w: F.when(w.isNull() | (w == ""), EDGE).otherwise(w))

    def wide(x: Column) -> Column:
        left = F.concat(at("before", x["s"]), F.substring(at("pieces", x["s"]), F.lit(1), x["s"] % PIECE))
        right = F.concat(F.substring(at("pieces", x["e"]), x["e"] % PIECE + 1, F.lit(PIECE)), at("after", x["e"]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), words(left, True).alias("left"), words(right, False).alias("right"))

    return F.transform(spans, wide)


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right doubled, divisible by 10."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, in order; matches that fail the kind's own test are dropped."""
    none = F.array().cast(SPAN)
    plain = F.replace(text, F.lit(MARK), F.lit(STAND_IN))
    digit = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), _spans(F.regexp_replace(plain, INNER_DOT, MARK), EMAIL)).otherwise(none)
    ip = F.when(text.rlike(IP), _spans(text, IP)).otherwise(none)
    card = F.when(digit, _spans(F.regexp_replace(plain, INNER_BLANK, MARK), CARD)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), _spans(text, PHONE)).otherwise(none)

    def is_card(x: Column) -> Column:
        d = _digits(x["value"])
        return F.char_length(d).between(13, 19) & _luhn(d)

    return {
        "email": email,
        "ip": F.filter(ip, lambda x: x["value"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        "card": F.filter(card, is_card),
        "phone": F.filter(phone, lambda x: F.char_length(_digits(x["value"])).between(9, 15)),
    }


def _scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document: a number for it, keep, its base spans by kind, and other strings with digits or at signs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("_text", text).select(F.monotonically_increasing_id().alias("rid"), *keep, "_text")
    found = found.withColumns({f"_{k}": c for k, c in base_spans(F.col("_text")).items()})
    words = _spans(F.col("_text"), TOKEN)
    found = found.withColumn("_tokens", F.when(F.col("_text").rlike("[0-9@]"), F.filter(F.transform(words, _trimmed), lambda x: x["e"] > x["s"])).otherwise(F.array().cast(SPAN)))
    known = F.concat(*(F.col(f"_{k}") for k in KINDS))
    free = _let(known, lambda all_: F.filter("_tokens", lambda t: ~F.exists(all_, lambda b: (b["s"] < t["e"]) & (b["e"] > t["s"]))))
    found = found.withColumn("_tokens", free)
    lists = [f"_{k}" for k in KINDS] + ["_tokens"]
    some = sum((F.size(c) for c in lists[1:]), F.size(lists[0])) > 0
    found = found.withColumn("_around", F.when(some, _around(F.col("_text")))).drop("_text")
    return written(found.withColumns({c: _with_words(F.col(c), F.col("_around")) for c in lists}).drop("_around"))


def _patterns(span: Column) -> Column:
    """The patterns that a span stands in: the words on both sides, and two words before it that end as a label does.

    Always two words, so that one common word alone is no pattern; a text's edge is no second word of a label.
    """
    l1, l2, r1 = span["left"][0], span["left"][1], span["right"][0]
    both = F.concat_ws("\t", F.lit("both"), l1, r1)
    label = F.when(l1.rlike(LABEL) & (l2 != EDGE), F.concat_ws("\t", F.lit("label"), l2, l1))
    return F.filter(F.array(both, label), lambda p: p.isNotNull())


def discovered(scanned: DataFrame, seeding: Callable[[Column], Column] | None = None) -> DataFrame | None:
    """(rid, kind, s, e) of the strings that good patterns hold; None where no pattern is good.

    seeding: which strings may be seeds (default: all of a seed's form), so that a test can hide some and see them found.
    Counts are of distinct strings, so one string that is copied a million times is one witness, and
    they are summed before they are shuffled.
    """

    def placed(spans: Column) -> DataFrame:
        return scanned.select("rid", F.explode(spans).alias("x")).select("rid", "x.s", "x.e", F.col("x.value").alias("value"), F.explode(_patterns(F.col("x"))).alias("pattern"))

    def of_kind(kind: str) -> Column:
        # Seeds of secrets are among the candidates, and are reported where a good pattern holds them.
        spans = F.col(f"_{kind}") if kind in KINDS else F.filter("_tokens", lambda x: x["value"].rlike(SECRET_SEED) & x["left"][0].rlike(LABEL))
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))

    # All kinds in one array: the table is read once for them, and the plan holds it once.
    seeds = scanned.select(F.explode(F.concat(*map(of_kind, ALL))).alias("_s")).select("_s.kind", F.col("_s.x.value").alias("value"), F.explode(_patterns(F.col("_s.x"))).alias("pattern"))
    seeds = written((seeds if seeding is None else seeds.where(seeding(F.col("value")))).distinct())
    places = placed(F.col("_tokens"))
    seen = seeds.select("pattern", "value").distinct()
    held = written(places.select("pattern", "value").distinct())
    sure = seeds.select("value", "kind", F.lit(1.0).alias("score")).distinct()
    trusted, scores, best = seen, sure, None
    for _ in range(ROUNDS):
        # What the round before found is a witness of its patterns, as a seed is.
        good = written(trusted.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"))
        # Written, as is what patterns are rated: else each of the joins below brings the plans of both along, and the driver's memory follows them.
        edges = written(held.unionByName(seen).distinct().join(good, "pattern"))
        total = edges.groupBy("pattern").agg(F.count_distinct("value").alias("all"))
        patterns = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        # What speaks for other kinds counts in full against a kind, what is unknown counts less.
        known = patterns.join(total, "pattern").withColumn("known", F.sum("score").over(Window.partitionBy("pattern")))
        weight = F.col("known") + UNKNOWN * F.greatest(F.col("all") - F.col("known"), F.lit(0.0)) + 0.5
        rated = written(known.select("pattern", "kind", (F.col("score") / weight).alias("rate")).where(F.col("rate") >= GOOD_PATTERN))
        told = edges.join(sure.where(F.col("kind") != SECRET).select("value").distinct(), "value", "left_anti").join(rated, "pattern").groupBy("value", "kind")
        likely = written(told.agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("rate"), F.lit(0.999)))))).alias("score")))
        dropped(good, edges)
        if not likely.limit(1).count():
            return None
        scores = sure.unionByName(likely.join(sure, ["value", "kind"], "left_anti").select("value", "kind", "score"))
        best = likely.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")).where(F.col("score") >= GOOD_STRING)
        trusted = seen.unionByName(held.join(best.select("value"), "value"))
    # A string is found where a pattern that the last round rates high for its kind holds it.
    return places.join(rated.select("pattern", "kind"), "pattern").join(best.select("value", "kind"), ["value", "kind"]).select("rid", "kind", "s", "e").distinct()


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep with base and spans (arrays of kind number, s, e, kind), in order of kind and place."""
    scanned = _scan(docs, keep)

    def numbered(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    rows = scanned.select("rid", *keep, F.concat(*map(numbered, KINDS)).alias("base"))
    more = discovered(scanned)
    if more is None:
        return rows.withColumn("spans", F.col("base")).drop("rid")
    number = F.array_position(F.array(*map(F.lit, ALL)), F.col("kind")).cast("int") - 1
    added = more.groupBy("rid").agg(F.collect_list(F.struct(number.alias("k"), "s", "e", "kind")).alias("more"))
    both = rows.join(added, "rid", "left")
    return both.withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))).drop("rid", "more")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base spans of every row of docs(doc_id, text), their hash, and all spans.

    A null or empty text has no spans. Repeated rows give repeated rows, null doc_ids stay null, other
    columns are ignored, an empty table gives no rows. Ends are exclusive; places count code points.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find(rows, ["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or what overlaps, replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(done: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, done["at"] + 1, x["s"] - done["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        fresh = x["s"] >= done["at"]
        return F.struct(F.when(fresh, F.concat(done["out"], F.array(piece))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["e"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(ordered, start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; all rows and columns stay, null texts stay null."""
    names = docs.columns
    inner, new, _ = numbered(docs)
    at = new[names.index("text")]
    found = find(inner.withColumn("text", F.col(at)), new)
    return found.withColumn(at, masked(F.col(at), F.col("spans"))).select(new).toDF(*names)
