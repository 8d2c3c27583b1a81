"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose values were exchanged has the
template of the original.  Windows of template tokens are joined by hash with those of the benchmark;
where they match, the exchanged values are held against each other: a value of the item must always
stand for the same value of the document, and the other way round.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import fresh, shared_table

# Units that follow a number.
UNITS = ["mm", "millimeter", "millimeters", "millimetre", "millimetres", "cm", "centimeter", "centimeters", "centimetre", "centimetres", "dm", "decimeter",
         "decimeters", "decimetre", "decimetres", "m", "meter", "meters", "metre", "metres", "km", "kilometer", "kilometers", "kilometre", "kilometres", "in",
         "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles", "acre", "acres", "ha", "hectare", "hectares",
         "mg", "milligram", "milligrams", "g", "kg", "kilo", "kilos", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "oz", "ounce",
         "ounces", "lb", "lbs", "pound", "pounds", "ml", "milliliter", "milliliters", "millilitre", "millilitres", "cl", "centiliter", "centiliters",
         "centilitre", "centilitres", "dl", "deciliter", "deciliters", "decilitre", "decilitres", "l", "liter", "liters", "litre", "litres", "gallon",
         "gallons", "quart", "quarts", "pint", "pints", "cup", "cups", "tsp", "teaspoon", "teaspoons", "tbsp", "tablespoon", "tablespoons",
         "ms", "millisecond", "milliseconds", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hr", "hrs", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "decade", "decades", "century", "centuries", "mph", "kph", "kmh",
         "hz", "khz", "mhz", "ghz", "hertz", "kilohertz", "megahertz", "gigahertz", "w", "watt", "watts", "kw", "kilowatt", "kilowatts", "mw", "megawatt",
         "megawatts", "v", "volt", "volts", "amp", "amps", "ampere", "amperes", "joule", "joules", "kj", "kilojoule", "kilojoules", "kcal", "calorie",
         "calories", "bit", "bits", "byte", "bytes", "kb", "kilobyte", "kilobytes", "mb", "megabyte", "megabytes", "gb", "gigabyte", "gigabytes", "tb",
         "terabyte", "terabytes", "dollar", "dollars", "cent", "cents", "euro", "euros", "penny", "pennies", "pence", "yen", "rupee", "rupees", "usd", "eur",
         "gbp", "jpy", "degree", "degrees", "percent"]
# Numbers written as words.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
                "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
                "hundred", "thousand", "million", "billion"]
#: Characters that mark the kind of the token they stand before (name, number, unit, word or name), and a point inside a number.
NAME, NUMBER, UNIT, EITHER, POINT = "\x02", "\x03", "\x04", "\x05", "\x06"
#: Readings of a text: numbers cut at their separators, numbers whole, and both where no number has one.
CUT, WHOLE, BOTH = 0, 1, 2
WINDOW, SHARE = 5, 0.8
#: Words that may be put in or left out between two alignments of a chain.
GAP = 3
#: The kind of numbers as ``windows`` codes it, and number words with the marks that they may carry.
NUMBER_KIND = 2
SPELLED = [mark + word for mark in ("", NAME, EITHER) for word in NUMBER_WORDS]
#: For each set of places that may be names (bits), without and with a name in the window: the sets to be taken as names, and
#: PLAIN for a reading without any.
PLAIN = 1 << WINDOW
CHOICES = [[s for s in range(PLAIN) if s & places == s] + [PLAIN] * named for named in (0, 1) for places in range(PLAIN)]
#: Benchmark windows up to this many (about 100 MB) are sent to every task; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def marked(text: Column, starts: bool) -> Column:
    """The text in lower case with currency signs as words and names marked; with ``starts`` the other
    capitalised words, which open a sentence, line or quote, are marked as a word or a name."""
    t = F.coalesce(text, F.lit(""))
    for sign, word in (("%", " percent "), ("$", f" {UNIT}usd "), ("€", f" {UNIT}eur "), ("£", f" {UNIT}gbp ")):
        t = F.replace(t, F.lit(sign), F.lit(word))
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?![\p{{L}}\p{{N}}])", EITHER + "$0")
    t = F.regexp_replace(t, rf"{EITHER}(?<=[\p{{L}}\p{{M}}\p{{N}},;:'\")] {EITHER})", NAME)
    return F.lower(t if starts else F.replace(t, F.lit(EITHER), F.lit("")))


def cut(t: Column) -> Column:
    """The tokens of a marked text, numbers and units marked as well."""
    t = F.regexp_replace(t, rf"\p{{N}}[\p{{N}}{POINT}]*", NUMBER + "$0")
    t = F.regexp_replace(t, rf"({NUMBER}[\p{{N}}{POINT}]+ *)(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", "$1 " + UNIT)
    return F.filter(F.split(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{POINT}]+|(?={NUMBER})"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """The words of a text in lower case; those of a kind start with its mark.

    A run of digits is a number (``windows`` takes ``NUMBER_WORDS`` for numbers, too); a unit is one of ``UNITS`` right after a number, or a currency sign; a
    name is a word with only its first letter in upper case, after a blank that does not end a
    sentence or line.  The kinds are marked in the whole text, which is then split."""
    return cut(marked(text, starts=False))


def readings(rows: DataFrame, text: Column, keys: dict[str, Column]) -> DataFrame:
    """``keys``, reading and tokens of each reading of ``text``.  Capitalised words that open a sentence
    may be names.  A text where separators stand inside numbers (1,200 or 2.5) is read twice: with
    numbers cut at them and with numbers whole (without the commas that group thousands)."""
    whole = F.regexp_replace(F.col("__t"), r"(?<=\p{N}),(?=\p{N}{3}(?!\p{N}))", "")
    whole = F.regexp_replace(whole, r"(?<=\p{N})[.,](?=\p{N})", POINT)
    read = lambda reading, t: F.struct(F.lit(reading).alias("reading"), t.alias("t"))
    each = F.when(F.col("__t").rlike(r"\p{N}[.,]\p{N}"), F.array(read(CUT, F.col("__t")), read(WHOLE, whole))).otherwise(F.array(read(BOTH, F.col("__t"))))
    rows = rows.select(*[c.alias(k) for k, c in keys.items()], marked(text, starts=True).alias("__t"))
    return rows.select(*keys, F.explode(each).alias("__r")).select(*keys, F.col("__r.reading").alias("reading"), cut(F.col("__r.t")).alias("tokens"))


def windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows of ``WINDOW`` tokens of ``rows`` (keys, tokens): keys, pos, template (hash of its words and
    kinds), named (whether a word that may be a name is taken as one) and v0, v1, ...: each token's
    hash with its kind in the lowest three bits.  A window is a row for every choice of what its
    tokens that may be names are, and if it holds names one more with all of them as plain words, so that text in
    another letter case has it as well; most windows are one row.

    Words of ``NUMBER_WORDS`` are numbers.  Only the hashing of tokens is a loop over an array; windows are made by
    exploding places and picking from arrays, inside generated code."""
    has = lambda w: w < POINT
    bare = lambda w: F.when(has(w), F.substring(w, 2, 1 << 30)).otherwise(w)
    kind = lambda w: F.when(w.isin(SPELLED), NUMBER_KIND).when(has(w), F.ascii(w) - 1).otherwise(0)
    coded = F.transform("tokens", lambda w: F.xxhash64(bare(w)).bitwiseAND(F.lit(-8)).bitwiseOR(kind(w).cast("long")))
    r = rows.select(*keys, coded.alias("codes")).filter(F.size("codes") >= WINDOW)
    r = r.select(*keys, "codes", F.explode(F.sequence(F.lit(0), F.size("codes") - WINDOW)).alias("pos"))
    r = r.select(*keys, "pos", *[F.get("codes", F.col("pos") + k).alias(f"v{k}") for k in range(WINDOW)])
    # a set bit 2 of a code says word or name: these places, and behind them whether any is a name
    open_ = sum((F.shiftleft(F.shiftright(F.col(f"v{k}").bitwiseAND(F.lit(4)), 2), k) for k in range(WINDOW)), F.lit(0)).cast("int")
    is_name = lambda k: F.col(f"v{k}").bitwiseAND(F.lit(7)) == 1
    named = is_name(0)
    for k in range(1, WINDOW):
        named = named | is_name(k)
    r = r.withColumn("open", F.when(named, open_ + PLAIN).otherwise(open_))
    r = r.withColumn("choice", F.explode(F.get(F.lit(CHOICES), F.col("open"))))
    taken = [F.when((F.col("choice") == PLAIN) & is_name(k), F.col(f"v{k}").bitwiseAND(F.lit(-8))).otherwise(
        F.col(f"v{k}").bitwiseAND(F.lit(-5)).bitwiseOR(F.shiftright("choice", k).bitwiseAND(F.lit(1)).cast("long"))).alias(f"v{k}") for k in range(WINDOW)]
    r = r.select(*keys, "pos", ((F.col("choice") > 0) & (F.col("choice") != PLAIN)).alias("named"), *taken)
    own = [F.when(is_value(f"v{k}"), F.col(f"v{k}").bitwiseAND(F.lit(7))).otherwise(F.col(f"v{k}")) for k in range(WINDOW)]
    return r.withColumn("template", F.xxhash64(*own))


def is_value(code: str) -> Column:
    return F.col(code).bitwiseAND(F.lit(7)) != 0


def one_to_one(pairs: Column) -> Column:
    """Whether distinct pairs give each value one partner, both ways."""
    return (F.size(pairs) == F.size(F.array_distinct(pairs["a"]))) & (F.size(pairs) == F.size(F.array_distinct(pairs["b"])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, windows, coverage, exchanged): a row per document and item it leaks.

    Windows that match at the same distance between document and item are one alignment; if its values
    do not stand for each other one to one it is discarded, but for the windows without sentence
    openers taken as names if those agree.  An item is leaked if in one of its readings the remaining
    alignments hold at least ``SHARE`` of its windows, or if a chain of alignments covers ``SHARE`` of its tokens: the longest
    alignment and, one by one, those at most ``GAP`` places nearer or farther whose values agree with the chain's.
    So a few words put in between cost nothing.  ``matched`` counts windows, ``coverage`` is the larger share, ``exchanged``
    counts values of the longest alignment that differ.
    Defined cases: null, empty and short texts (under ``WINDOW`` tokens), in documents or items, hold
    no window and neither leak nor match; repeated documents and repeated items are reported once per id
    and text, so different texts under one id are items of their own; null ids are ids; empty tables give no rows; other columns are ignored."""
    item = ["item_id", "item_hash"]
    items = readings(benchmark, F.col(item_text_col), {"item_id": F.col(item_col), "item_hash": F.xxhash64(item_text_col)})
    items = windows(items, [*item, "reading"]).withColumnsRenamed({"pos": "item_pos", "reading": "item_reading", "named": "item_named", **{f"v{k}": f"i{k}" for k in range(WINDOW)}})
    items = shared_table(items.dropDuplicates([*item, "item_reading", "item_pos", "template"]), "benchmark-windows")
    total = items.groupBy(*item, "item_reading").agg(F.countDistinct("item_pos").alias("windows"))
    small = items.count() <= broadcast_windows

    rows = readings(docs, F.col(text_col), {"doc_id": F.col(id_col), "text_hash": F.xxhash64(text_col)})
    found = windows(rows, ["doc_id", "text_hash", "reading"]).join(F.broadcast(items) if small else items, "template")
    found = found.filter((F.col("reading") == F.col("item_reading")) | (F.col("reading") == BOTH) | (F.col("item_reading") == BOTH))
    pairs = F.array_compact(F.array(*[F.when(is_value(f"i{k}"), F.struct(F.col(f"i{k}").alias("a"), F.col(f"v{k}").alias("b"))) for k in range(WINDOW)]))
    keys = ["doc_id", "text_hash", *item]
    found = found.select(*keys, "item_reading", "reading", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"),
                         (~F.col("named") & ~F.col("item_named")).alias("plain"))
    # an alignment has at most as many windows as its item
    way = lambda plain, chosen: F.struct(F.lit(plain).alias("plain"), F.collect_set(F.when(chosen, F.col("item_pos"))).alias("places"),
                                         F.array_distinct(F.flatten(F.collect_set(F.when(chosen, F.col("pairs"))))).alias("pairs"))
    runs = found.groupBy(*keys, "item_reading", "reading", "shift").agg(F.array(way(0, F.lit(True)), way(1, F.col("plain"))).alias("ways"))
    runs = runs.select(*keys, "item_reading", "reading", "shift", F.explode("ways").alias("way"))
    runs = runs.select(*keys, "item_reading", F.struct(F.size("way.places").alias("n"), "shift", "way.plain", "reading", "way.places", "way.pairs").alias("run"))
    runs = runs.filter((F.col("run.n") > 0) & one_to_one(F.col("run.pairs")))
    kind = runs.schema["run"].dataType
    none = F.struct(F.array().cast("array<bigint>").alias("shifts"), *[F.array().cast(kind[c].dataType).alias(c) for c in ("places", "pairs")])

    def join(held: Column, run: Column) -> Column:
        pairs, shift = F.array_union(held["pairs"], run["pairs"]), run["shift"].cast("bigint")
        near = (F.size(held["shifts"]) == 0) | F.exists(held["shifts"], lambda s: F.abs(s - shift) <= GAP)
        return F.when(near & one_to_one(pairs), F.struct(F.array_union(held["shifts"], F.array(shift)).alias("shifts"),
                                                         F.array_union(held["places"], run["places"]).alias("places"), pairs.alias("pairs"))).otherwise(held)

    leaks = runs.groupBy(*keys, "item_reading").agg(F.reverse(F.array_sort(F.collect_list("run"))).alias("runs"))
    leaks = leaks.withColumn("chain", F.aggregate("runs", none, join))
    covered = F.array_distinct(F.flatten(F.transform("chain.places", lambda p: F.sequence(p, p + (WINDOW - 1)))))
    leaks = leaks.select(*keys, "item_reading", F.size(F.array_distinct(F.flatten("runs.places"))).alias("matched"), F.size(covered).alias("covered"),
                         F.size(F.filter(F.get("runs", F.lit(0))["pairs"], lambda p: p["a"] != p["b"])).alias("exchanged"))
    same = [leaks[c].eqNullSafe(total[c]) for c in (*item, "item_reading")]
    share = F.greatest(F.col("matched") / F.col("windows"), F.col("covered") / (F.col("windows") + (WINDOW - 1)))
    leaks = leaks.join(total, same).select(*[leaks[c] for c in leaks.columns], "windows").withColumn("coverage", share)
    best = F.max(F.struct("coverage", "matched", "windows", "exchanged")).alias("best")
    leaks = leaks.filter(F.col("coverage") >= SHARE).groupBy(*keys).agg(best)
    return leaks.select("doc_id", "text_hash", "item_id", "best.matched", "best.windows", "best.coverage", "best.exchanged")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that leak an item; columns stay as they are, whatever their names.

    Repeated rows go or stay together; null, empty and short texts stay; texts of any length are read whole; a
    table without rows gives none, and without items all documents stay."""
    own_id, own_hash = fresh(docs, "leaked_id"), fresh(docs, "leaked_hash")
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash)), "left_anti")
