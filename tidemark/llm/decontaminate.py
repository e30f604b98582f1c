"""Benchmark decontamination by template canonicalisation, native plans only.

Numbers, units behind numbers and names (capitalised words inside a sentence)
become typed placeholders, so a question whose parameters were changed keeps
its template. Windows of ``WINDOW`` template words are hashed and joined with
the benchmark's windows. Matches of a document and an item are sorted into
bands of diagonals (``BAND`` words wide, overlapping by half), each one an
alignment. An alignment contaminates if it finds windows at ``COVER`` of the
item's window places or more and, within it, the slots are consistent: each of
the item's slot values stands for one value of the document wherever it
recurs, and each value of the document for one of the item's.

Beside the templates, windows of plain lower-cased words find verbatim copies
whatever their case, line breaks or preceding words: ``COVER`` of an item's
plain windows in one alignment, or all of them if no template window of the
item is usable. Pairs that only these find are reported with their counts and
without slots.

Everything is a DataFrame expression: regular expressions, array functions, a
hash join on 64-bit window hashes, grouped aggregates. Texts are not shuffled.
A bitmap over the first and last words of the benchmark's windows (at most
``GATE_MOST`` words of 64 bits, a literal of the plan) decides inside the scan
which places of a text are hashed and leave it; a false hit costs one hash.
The benchmark's windows are broadcast up to ``BROADCAST_WINDOWS`` of them
(counted first; 24 bytes each); beyond that the same join is a shuffle join of
(document, place, hash), which AQE splits where a window is frequent, and the
slot values of the matches are read in a second scan of their documents.

Defined cases: null texts and texts under the smallest window match nothing;
items of 5 to 7 words are one window of their own length; items of 1 to 4
words are found where they are the whole text, as anything shorter than a
window would be found in clean text too; a template window of more than half
placeholders is not used; items with one template and the same slot values
report under their smallest id; rows repeated with one id count as one
document; a null id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, drop_ids, in_bitmap, materialize, table

WINDOW = 8
SHORTEST = 5
COVER = 0.5
BAND = 32
BROADCAST_WINDOWS = 500_000
#: Words of 64 bits in the bitmap of places worth a hash: at least, at most.
GATE_LEAST, GATE_MOST = 1 << 12, 1 << 16

#: Units that follow a number.
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|lb|lbs|oz|ml|l|kmh|mph|km/h|m/s|s|sec|secs|seconds|second|min|mins|minutes|minute|h|hr|hrs|hours|hour|"
    "days|day|weeks|week|months|month|years|year|percent|dollars|dollar|euros|euro|cents|cent|pounds|pound|miles|mile|feet|foot|"
    "inches|inch|meters|meter|metres|metre|kilometers|kilometres|liters|litres|grams|degrees|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|v|usd|eur"
)
NUM, NAME, UNIT = "\x01", "\x02", "\x03"

#: (pattern, replacement) in order; the same in Java and RE2 syntax. Marks
#: precede the value, so slot values stay readable beside the template.
MARKS = (
    (rf"[{NUM}-{UNIT}]+", " "),
    (r"([0-9]+(?:[.,][0-9]+)*)", f" {NUM}$1 "),
    (rf"({NUM}[0-9.,]+ +)({UNITS})([^\p{{L}}]|$)", f"$1{UNIT}$2$3"),
    (r"([\p{L}\p{N},;:] +)(\p{Lu}\p{Ll}+)", f"$1{NAME}$2"),
    (r"([\p{L}\p{N},;:] +)(\p{Lu}\p{Ll}+)", f"$1{NAME}$2"),  # neighbours of a name just marked
)
VALUES = rf"([{NUM}-{UNIT}])[\p{{L}}0-9.,]+"
GAPS = rf"[^\p{{L}}{NUM}-{UNIT}]+"
WORD = rf"[{NUM}-{UNIT}][\p{{L}}0-9.,]+|\p{{L}}+"
PLACEHOLDER = f"[{NUM}{NAME}{UNIT}]"


def marked(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in MARKS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def template(marked_text: Column) -> Column:
    """Array of template words: placeholders for slots, else lower case."""
    plain = F.regexp_replace(marked_text, VALUES, "$1 ")
    return F.array_remove(F.split(F.lower(plain), GAPS), "")


def values(marked_text: Column) -> Column:
    """Array aligned with ``template``: a slot's value, else ''."""
    words = F.regexp_extract_all(marked_text, F.lit(WORD), F.lit(0))
    bare = lambda w: F.lower(F.regexp_replace(F.substring(w, 2, 0x7FFFFFFF), "[.,]+$", ""))
    return F.transform(words, lambda w: F.when(w.rlike(f"^{PLACEHOLDER}"), bare(w)).otherwise(""))


def plain(text: Column) -> Column:
    """Array of lower-cased words and numbers."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _literal(words: Column) -> Column:
    """How many words are no placeholders."""
    return F.size(F.filter(words, lambda w: ~w.rlike(f"^{PLACEHOLDER}")))


def _hash(words: Column, at: Column, size: Column | int) -> Column:
    return F.xxhash64(F.slice(words, at + 1, size))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, slots, text) of the different items."""
    items = benchmark.select(benchmark[id_col].alias("item"), benchmark[text_col].alias("text"), marked(benchmark[text_col]).alias("mt"))
    items = items.withColumn("words", template(F.col("mt"))).filter(F.size("words") > 0)
    return items.groupBy("words", values(F.col("mt")).alias("slots")).agg(F.min("item").alias("item"), F.min_by("text", "item").alias("text"))


def _placed(items: DataFrame, window: int) -> DataFrame:
    """One row per window place of items of ``SHORTEST`` words or more."""
    items = items.filter(F.size("words") >= SHORTEST).withColumn("size", F.least(F.size("words"), F.lit(window)))
    rows = items.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    return rows.withColumn("gate", _gate(F.col("words"), F.col("place"), F.col("size"))).withColumn("hash", _hash(F.col("words"), F.col("place"), F.col("size")))


def _usable(words: Column, place: Column, size: Column) -> Column:
    return _literal(F.slice(words, place + 1, size)) * 2 >= size


def benchmark_windows(items: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(size, gate, hash, item, place, n_item, need, slots) of every usable
    template window; ``n_item``: how many its item has, ``need``: how many of
    them must be found, ``slots``: the item's values in the window."""
    rows = _placed(items, window).filter(_usable(F.col("words"), F.col("place"), F.col("size")))
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    rows = rows.select("item", "size", "place", "gate", "hash", F.slice("slots", F.col("place") + 1, F.col("size")).alias("slots"))
    return rows.join(counts, "item").withColumn("need", F.col("n_item") * F.lit(cover))


def plain_windows(items: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """The same of every window of plain words, without slots."""
    size = F.least(F.size("words"), F.lit(window))
    usable = F.exists(F.sequence(F.lit(0), F.size("words") - size), lambda at: _usable(F.col("words"), at, size))
    some = (F.size("words") >= SHORTEST) & usable
    rows = _placed(items.select("item", some.alias("usable"), plain(F.col("text")).alias("words")), window)
    n = (F.size("words") - F.col("size") + 1).cast("long")
    return rows.select("item", "size", "place", "gate", "hash", n.alias("n_item"), F.when(F.col("usable"), n * F.lit(cover)).otherwise(n.cast("double")).alias("need"))


def _gate(words: Column, at: Column, size: Column | int) -> Column:
    """What a place must have in common with a window to be worth its hash."""
    return F.xxhash64(F.get(words, at), F.get(words, at + size - 1))


def _found(source: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc, pos, windows of ``bench``) of equal windows; ``source``: (doc, words)."""
    shape = bench.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 rows
    total = sum(r["n"] for r in shape)
    many = min(GATE_MOST, max(GATE_LEAST, 1 << max(0, total // 8 - 1).bit_length()))
    slot = lambda gate: F.pmod(gate, F.lit(many * 64))
    bit = lambda gate: slot(gate).bitwiseAND(63).cast("int")
    word = lambda gate: F.floor(slot(gate) / 64).cast("int")
    gate = F.col("gate")
    held = bench.groupBy(word(gate).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(gate))).alias("bits"))
    bits = [0] * many
    for r in held.collect():  # at most GATE_MOST rows
        bits[r["w"]] = r["bits"]
    table = F.from_json(F.lit(str(bits)), "array<bigint>")

    def windows(size: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - size)
        hit = lambda at: F.call_function("shiftright", F.get(table, word(_gate(F.col("words"), at, size))), bit(_gate(F.col("words"), at, size))).bitwiseAND(1) == 1
        one = lambda at: F.struct(F.lit(size).alias("dsize"), at.alias("pos"), _hash(F.col("words"), at, size).alias("dhash"))
        return F.when(F.size("words") >= size, F.transform(F.filter(places, hit), one)).otherwise(F.array())

    each = [windows(n) for n in sorted(r["size"] for r in shape) or [WINDOW]]
    rows = source.select("doc", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("w")).select("doc", "w.*")
    side = F.broadcast(bench) if total <= BROADCAST_WINDOWS else bench
    return rows.join(side, (F.col("dhash") == F.col("hash")) & (F.col("dsize") == F.col("size"))).drop("dhash", "dsize", "hash", "gate")


def _banded(hit: DataFrame) -> DataFrame:
    """Every match in the two bands of diagonals that it belongs to."""
    line = (F.col("pos") - F.col("place")) / float(BAND)
    bands = [F.struct(F.lit(k).alias("grid"), F.floor(line + k / 2).alias("at")) for k in range(2)]
    return hit.withColumn("band", F.explode(F.array(*bands)))


def _covered(hit: DataFrame) -> DataFrame:
    """(doc, item, band, n_windows, n_item) of the bands with enough places."""
    places = hit.groupBy("doc", "item", "band", "place").agg(F.min("n_item").alias("n_item"), F.min("need").alias("need"))
    found = places.groupBy("doc", "item", "band").agg(F.count(F.lit(1)).alias("n_windows"), F.min("n_item").alias("n_item"), F.min("need").alias("need"))
    return found.filter("n_windows >= need").drop("need")


def _slots(docs: DataFrame, hit: DataFrame) -> DataFrame:
    """(doc, item, band, n_slots, n_changed, ok) of alignments with slots.
    ``docs``: (doc, text); only documents in ``hit`` are marked again."""
    wanted = hit.filter(F.exists("slots", lambda v: v != "")).select("doc", "item", "band", "pos", "size", "slots")
    wanted = materialize(wanted, "bench-slots")
    ids = wanted.select(F.col("doc").alias("id")).distinct()
    bits = bitmap(ids.withColumn("__dk", F.xxhash64("id")), "__dk", "bench-ids")
    texts = in_bitmap(docs.withColumn("__dk", F.xxhash64("doc")), bits, "__dk", "__maybe").filter("__maybe")
    texts = texts.select(F.col("doc").alias("id"), values(marked(F.col("text"))).alias("v"))
    pairs = wanted.join(texts, wanted["doc"].eqNullSafe(texts["id"])).select("doc", "item", "band", "slots", F.slice("v", F.col("pos") + 1, F.col("size")).alias("found"))
    pairs = pairs.select("doc", "item", "band", F.explode(F.arrays_zip("slots", "found")).alias("p")).filter("p.slots != ''")
    pairs = pairs.select("doc", "item", "band", F.col("p.slots").alias("theirs"), F.coalesce("p.found", F.lit("")).alias("ours")).distinct()
    once = lambda side: pairs.groupBy("doc", "item", "band", side).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("ours") != F.col("theirs")).cast("int")).alias("changed"))
    line = once("theirs").groupBy("doc", "item", "band").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("changed").alias("n_changed"), F.max("n").alias("m"))
    back = once("ours").groupBy(F.col("doc").alias("d"), F.col("item").alias("i"), F.col("band").alias("b")).agg(F.max("n").alias("k"))
    both = line.join(back, line["doc"].eqNullSafe(back["d"]) & (line["item"] == back["i"]) & (line["band"] == back["b"]))
    return both.select("doc", "item", "band", "n_slots", "n_changed", ((F.col("m") == 1) & (F.col("k") == 1)).alias("ok"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows, n_slots, n_changed of every
    contaminated (document, item)."""
    items = materialize(_items(benchmark, "item_id", "text"), "bench-items")
    source = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    bench = materialize(benchmark_windows(items, cover=cover), "bench-windows")
    hit = materialize(_found(source.select("doc", template(marked(F.col("text"))).alias("words")), bench), "bench-matches")
    hit = _banded(hit)
    band = materialize(_covered(hit), "bench-covered")
    kept = hit.alias("h").join(band.alias("c"), F.col("h.doc").eqNullSafe(F.col("c.doc")) & (F.col("h.item") == F.col("c.item")) & (F.col("h.band") == F.col("c.band")), "left_semi")
    slots = _slots(source, kept)
    same = F.col("c.doc").eqNullSafe(F.col("s.doc")) & (F.col("c.item") == F.col("s.item")) & (F.col("c.band") == F.col("s.band"))
    found = band.alias("c").join(slots.alias("s"), same, "left").filter("s.ok is null or s.ok")
    zero = F.lit(0).cast("long")
    found = found.select("c.doc", "c.item", F.lit(0).alias("plain"), "n_windows", "n_item", F.coalesce("n_slots", zero).alias("n_slots"), F.coalesce("n_changed", zero).alias("n_changed"))

    bench = materialize(plain_windows(items, cover=cover), "bench-plain")
    words = source.select("doc", plain(F.col("text")).alias("words"))
    copies = _covered(_banded(materialize(_found(words, bench), "bench-verbatim")))
    copies = copies.select("doc", "item", F.lit(1).alias("plain"), "n_windows", "n_item", zero.alias("n_slots"), zero.alias("n_changed"))

    # items shorter than the smallest window: the whole text or nothing
    short = items.select("item", plain(F.col("text")).alias("words")).filter((F.size("words") > 0) & (F.size("words") < SHORTEST))
    short = short.groupBy("words").agg(F.min("item").alias("item"))
    brief = words.filter((F.size("words") > 0) & (F.size("words") < SHORTEST)).join(short, "words")
    one = F.lit(1).cast("long")
    brief = brief.select("doc", "item", F.lit(1).alias("plain"), one.alias("n_windows"), one.alias("n_item"), zero.alias("n_slots"), zero.alias("n_changed"))

    # of several alignments: a template's before a plain one, the longest, the least changed
    best = F.min(F.struct("plain", (-F.col("n_windows")).alias("less"), "n_changed", (-F.col("n_slots")).alias("few"), "n_item")).alias("b")
    out = found.unionByName(copies).unionByName(brief).groupBy("doc", "item").agg(best)
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        (-F.col("b.less")).alias("n_windows"),
        F.col("b.n_item").alias("n_item_windows"),
        (-F.col("b.few")).alias("n_slots"),
        F.col("b.n_changed").alias("n_changed"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; all columns kept."""
    return drop_ids(docs, contaminated(docs, benchmark, id_col, text_col).select("doc_id"), id_col)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _duck(column: str) -> str:
    """``template`` in DuckDB: the same expressions, RE2 spelling."""
    out = f"coalesce({column}, '')"
    for pattern, replacement in MARKS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return out


_WORDS = f"list_filter(string_split_regex(lower(regexp_replace(m, '{VALUES}', '\\1 ', 'g')), '{GAPS}'), lambda x: x <> '')"
#: For benchmarks whose items have no slots (the test tables): windows and
#: coverage; slot consistency is tested on fixtures.
ORACLE_SQL = f"""
with b0 as (select item_id, {_duck('text')} as m from benchmark),
b1 as (select min(item_id) as item, w from (select item_id, {_WORDS} as w from b0) where len(w) >= {SHORTEST} group by w),
b2 as (select item, w, least(len(w), {WINDOW}) as n, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) as place from b1),
b3 as (select item, n, place, w[place:place + n - 1] as win from b2),
b4 as (select *, array_to_string(win, ' ') as s from b3 where len(list_filter(win, lambda x: not regexp_matches(x, '^{PLACEHOLDER}'))) * 2 >= n),
b5 as (select item, count(*) as n_item from b4 group by item),
d0 as (select doc_id, {_duck('text')} as m from documents),
d1 as (select doc_id, {_WORDS} as w from d0),
d2 as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as pos from d1, (select distinct n from b4) where len(w) >= n),
d3 as (select doc_id, n, array_to_string(w[pos:pos + n - 1], ' ') as s from d2),
c as (select d3.doc_id, b4.item, count(distinct b4.place) as n_windows from d3 join b4 on d3.s = b4.s and d3.n = b4.n group by all)
select c.doc_id, c.item as item_id, n_windows, n_item as n_item_windows, cast(0 as bigint) as n_slots, cast(0 as bigint) as n_changed
from c join b5 on c.item = b5.item where n_windows >= {COVER} * n_item
"""
