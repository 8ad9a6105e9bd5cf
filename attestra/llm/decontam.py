"""Benchmark decontamination by template canonicalisation.

A text becomes template tokens: words in lower case; numbers, names and units as the typed placeholders <num>, <name>
and <unit>. A name is a capitalised word, those of ``STARTERS`` aside, which begin sentences; a unit is a word of ``UNITS``
right after a number. A capitalised word that begins a sentence of an item may be a name or not, so its windows are looked up
both ways. Windows of ``size`` template tokens of documents and items are joined by hash. Windows that hit on one diagonal
(document place less item place) are one occurrence, and its slots must be consistent: each value that a placeholder
has in the item always stands against the same value in the document. So a question with other numbers and names
put in is caught, while a text that only shares its shape, with values at odds, is not.

A window that holds more placeholders than words says little by its shape. It counts when its values are those of the item
too, or when its occurrence bears it out: one of its windows has as many words as placeholders, or it has several with
words that repeat a value, or all of the item's. Windows without a word are looked up by their values alone.

A pair (document, item) is reported when at least ``min(least, half)`` of the item's windows are hit in
occurrences with consistent slots (half: of its windows, rounded up). Windows that are equal word by word count in other
occurrences too; where the rest does not reach that number, all of them together must reach half. An item with fewer than ``size`` tokens is one
window of its own length; below ``shortest`` tokens its shape tells nothing, and it is looked up by its values alone, word for word.

Each document is cut into tokens once and each token hashed once; the windows of all sizes that items have are then made in one
pass from the tokens' hashes, inside one generated stage with the semi join on the items' hashes. A window that is hit takes along the
hashes of its own tokens alone, never its document, and values are compared by these. Items with the same texts are one class, which
is met once; items take the place of their class at the end. What the windows' hits are is written once, as three steps read it.
Hashes are broadcast only if measured at no more than four times ``broadcast_rows`` rows, as each is one long, and items' windows at no more
than a quarter of it; else they are joined by shuffle, and the tokens of windows that are hit are looked up in a second pass over the documents that are hit.
Only built-in functions are used.

Defined results: null and empty texts and items hit nothing; rows with one id count as one document; a null doc_id is reported
as null; rows that repeat change nothing; very long items have as many windows as tokens; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import unused
from .text import text_key

#: Fixed list: words that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh"
).split()
#: Fixed list: words that begin sentences and are no names.
STARTERS = (
    "the a an in on at it if is are was were to of for from by with as and but or so he she we you they this that these those there here "
    "what where when who whom whose why which how each every all some no not after before while then since until during under over "
    "do does did can could will would should may might must let find solve suppose given compute calculate determine consider sort"
).split()
NAME = r"(?<!\p{L})(\p{Lu}\p{Ll}+)(?!\p{L})"
#: A capitalised word inside a sentence.
INNER_NAME = r"(?<=[\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)(?!\p{L})"
TOKEN = r"\x01?\p{L}+|[0-9]+(?:[.,:/][0-9]+)*"
MARK = "\x01"


def raw_tokens(text: Column, name: str = NAME) -> Column:
    """Words and numbers in turn; names with a mark before them."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    return F.regexp_extract_all(F.regexp_replace(t, name, MARK + "$1"), F.lit(TOKEN), F.lit(0))


def tokenised(rows: DataFrame) -> DataFrame:
    """``rows(raw)`` with words (lower case, no marks), vh (hashes of words) and th (hashes of template tokens).

    The lowest bit of a template token's hash tells whether it is a placeholder.
    """
    rows = rows.withColumn("words", F.transform("raw", lambda t: F.lower(F.ltrim(t, F.lit(MARK)))))
    rows = rows.withColumn("vh", F.transform("words", lambda w: F.xxhash64(w)))
    slot = lambda n: F.lit(n).cast("long")
    unit = lambda w, i: (i > 0) & F.get("raw", i - 1).between("0", ":") & w.isin(UNITS)
    even = lambda h: h.bitwiseAND(F.lit(-2).cast("long"))
    kind = lambda t, i: F.when(t < "A", F.when(t.startswith(MARK), F.when(F.get("words", i).isin(STARTERS), even(F.get("vh", i))).otherwise(slot(3))).otherwise(slot(1))).when(unit(F.get("words", i), i), slot(5)).otherwise(even(F.get("vh", i)))
    return rows.withColumn("th", F.transform("raw", kind))


def _is_slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(1).cast("long")) == 1


def window_hash(at: Column, size: int, shortest: int) -> Column:
    """The hash of the window of ``size`` tokens at ``at``: of its template, or of its values where it has no word or is too short."""
    th, vh = ([F.get(c, at + i) for i in range(size)] for c in ("th", "vh"))
    values = F.xxhash64(F.lit(-size), *vh)
    if size < shortest:
        return values
    return F.when(_is_slot(reduce(lambda p, q: p.bitwiseAND(q), th)), values).otherwise(F.xxhash64(F.lit(size), *th))


def _any_size(at: Column, size: Column, sizes: list[int], shortest: int) -> Column:
    return F.coalesce(*(F.when(size == n, window_hash(at, n, shortest)) for n in sizes))


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, class, texts): rows with one item_id are one item; items with the same texts are of one class."""
    rows = items.groupBy("item_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return rows.select("item_id", F.xxhash64("texts").alias("class"), "texts")


def _item_rows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, named, raw, words, vh, th, size): items as tokens, with the words that begin sentences as words and, if that differs, as names."""
    rows = items.select("item_id", F.explode(F.array(*(F.struct(F.lit(named).alias("named"), raw_tokens(F.col("text"), p).alias("raw")) for named, p in ((False, INNER_NAME), (True, NAME))))).alias("x"))
    rows = tokenised(rows.select("item_id", "x.*").where("size(raw) > 0"))
    return rows.dropDuplicates(["item_id", "th", "words"]).withColumn("size", F.least(F.lit(size), F.size("raw")))


def _item_windows(rows: DataFrame, sizes: list[int], shortest: int) -> DataFrame:
    """(item_id, named, size, item_at, h, item_th, item_vh, heavy, worded, n_worded) of every window.

    ``item_th`` and ``item_vh`` are its tokens' hashes; ``heavy``: it holds more placeholders than words; ``worded``: it holds a word;
    ``n_worded``: the windows of its text that do.
    """
    rows = rows.select("item_id", "named", "th", "vh", "size", F.explode(F.sequence(F.lit(0), F.size("th") - F.col("size"))).alias("item_at"))
    part = lambda c: F.slice(c, F.col("item_at") + 1, F.col("size"))
    slots = F.size(F.filter(part("th"), _is_slot))
    rows = rows.withColumn("slots", F.when(F.col("size") < shortest, 0).otherwise(slots))
    rows = rows.select("item_id", "named", "size", "item_at", _any_size(F.col("item_at"), F.col("size"), sizes, shortest).alias("h"), part("th").alias("item_th"), part("vh").alias("item_vh"), (2 * F.col("slots") > F.col("size")).alias("heavy"), (F.col("slots") < F.col("size")).alias("worded"))
    n = rows.groupBy("item_id", "named").agg(F.count_if("worded").alias("n_worded"))
    return rows.join(n, ["item_id", "named"])


def document_windows(docs: DataFrame, sizes: list[int], shortest: int) -> DataFrame:
    """(doc_id, text_key, vh, at, h) of every window of a document, of all sizes; vh has the hashes of all its words."""
    rows = _document_tokens(docs)
    n = F.size("th")
    # The outer form keeps Spark from working out the tokens once more, for each of them, in a filter below.
    places = F.explode_outer(F.when(n >= min(sizes), F.sequence(F.lit(0), n - min(sizes))))
    rows = rows.select("doc_id", "text_key", "th", "vh", places.alias("at")).where("at is not null")
    made = [F.when(F.col("at") + s <= n, window_hash(F.col("at"), s, shortest)) for s in sizes]
    rows = rows.select("doc_id", "text_key", "vh", "at", (made[0] if len(made) == 1 else F.explode(F.array(*made))).alias("h"))
    return rows.where("h is not null")


def _document_tokens(docs: DataFrame) -> DataFrame:
    return tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), raw_tokens(F.col("text")).alias("raw")))


def window_hits(docs: DataFrame, hashes: DataFrame, sizes: list[int], shortest: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, text_key, at, h, doc_vh) of the windows whose hash is in ``hashes(h)``; doc_vh has the hashes of the words from there on, as many as the largest size.

    Where the hashes are too many to be broadcast, windows are shuffled by hash without their words: those are then looked up for each document that is hit.
    """
    said = F.slice("vh", F.col("at") + 1, max(sizes)).alias("doc_vh")
    made = document_windows(docs, sizes, shortest)
    if hashes.count() <= 4 * broadcast_rows:
        return written(made.join(F.broadcast(hashes), "h", "left_semi").select("doc_id", "text_key", "at", "h", said), "decontam-hits")
    met = made.drop("vh").join(hashes, "h", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "h")).alias("met"))
    met = met.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "met")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").join(met.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    rows = tokenised(rows.select("doc_id", "text_key", "met", raw_tokens(F.col("text")).alias("raw")))
    rows = rows.select("doc_id", "text_key", "vh", F.inline("met")).select("doc_id", "text_key", "at", "h", said)
    return written(rows, "decontam-hits")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 8, least: int = 6, shortest: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hit, n_exact): pairs of documents and items that they hold, ``n_exact`` windows word by word."""
    classes = written(item_classes(items), "decontam-classes")
    held = held_classes(docs, classes, size, least, shortest, broadcast_rows)
    return held.join(classes.select("item_id", "class"), "class").select("doc_id", "item_id", "n_windows", "n_hit", "n_exact")


def held_classes(docs: DataFrame, classes: DataFrame, size: int = 8, least: int = 6, shortest: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, class, n_windows, n_hit, n_exact): what ``contaminated`` gives, for classes of ``item_classes`` in the place of items."""
    items = classes.dropDuplicates(["class"]).select(F.col("class").alias("item_id"), F.explode("texts").alias("text"))
    known = written(_item_rows(items, size), "decontam-items")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [size]  # at most ``size`` numbers
    windows = written(_item_windows(known, sizes, shortest), "decontam-windows")
    hashes = written(windows.select("h").distinct(), "decontam-hashes")
    found = window_hits(docs, hashes, sizes, shortest, broadcast_rows)
    hits = found.join(F.broadcast(windows) if 4 * windows.count() <= broadcast_rows else windows.hint("merge"), "h")
    zipped = F.arrays_zip(F.col("item_vh").alias("item"), F.slice("doc_vh", F.lit(1), F.col("size")).alias("doc"), F.col("item_th").alias("th"))
    places = F.filter(F.transform(zipped, lambda p, i: F.struct(p["th"].alias("kind"), p["item"].alias("item"), p["doc"].alias("doc"), (F.col("item_at") + i).alias("place"))), lambda p: _is_slot(p["kind"]))
    by = ["doc_id", "text_key", "item_id", "named", "run"]
    hits = hits.select(*by[:-1], (F.col("at") - F.col("item_at")).alias("run"), "item_at", places.alias("slots"), F.forall(zipped, lambda p: p["item"] == p["doc"]).alias("exact"), "heavy", "worded", "n_worded")
    hits = written(hits.distinct(), "decontam-pairs")
    same = lambda x, y: reduce(lambda p, q: p & q, (x[c].eqNullSafe(y[c]) for c in by))
    slots = hits.select(*by, F.explode("slots").alias("p")).groupBy(*by, "p.kind", "p.item").agg(F.count_distinct("p.doc").alias("n"), F.count_distinct("p.place").alias("n_places"))
    slots = slots.groupBy(*by).agg(F.bool_or(F.col("n") > 1).alias("odd"), F.bool_or(F.col("n_places") > 1).alias("repeats"))
    runs = hits.groupBy(*by).agg(F.bool_or(~F.col("heavy")).alias("light"), F.count_if("worded").alias("n_seen"), F.max("n_worded").alias("n_all"))
    several = (F.col("n_seen") > 1) & (F.coalesce("repeats", F.lit(False)) | (F.col("n_seen") == F.col("n_all")))
    runs = runs.join(slots, same(runs, slots), "left").select(*(runs[c].alias(f"_{c}") for c in by), (F.col("light") | several).alias("backed"), F.coalesce("odd", F.lit(False)).alias("odd"))
    held = hits.join(runs, reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))).where(F.col("exact") | (~F.col("odd") & (~F.col("heavy") | F.col("backed"))))
    held = held.groupBy("doc_id", "item_id", "item_at").agg(F.max("exact").alias("exact"), F.min("odd").alias("odd"))
    held = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hit"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("odd")).alias("n_even"))
    totals = windows.select("item_id", "item_at").distinct().groupBy("item_id").agg(F.count("*").alias("n_windows"))
    held = held.join(totals, "item_id").select("doc_id", F.col("item_id").alias("class"), "n_windows", "n_hit", "n_exact", "n_even")
    half = F.ceil(F.col("n_windows") / 2)
    return held.where((F.col("n_even") >= F.least(F.lit(least), half)) | (F.col("n_hit") >= half)).drop("n_even")


def cleaned(docs: DataFrame, items: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null doc_id go if any of them does.

    The ids to drop are broadcast if counted at no more than ``broadcast_rows``; beyond that texts are shuffled by id.
    """
    (bad,) = unused(docs, "_bad")
    ids = written(held_classes(docs, item_classes(items), broadcast_rows=broadcast_rows).select(F.col("doc_id").alias(bad)).distinct(), "decontam-found")
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids[bad]), "left_anti")
