"""Benchmark decontamination by templates: typed placeholders, seed joins, slot consistency.

Numbers, names and units of a text become placeholders that keep their value beside them.
Seeds of the resulting templates are joined by hash between benchmark and documents, at every place
of both. A seed is some words of a short stretch with gaps between them (4 of 7, for some lengths 3
of 5 or fewer), chosen by the item's length so that wherever ``share`` of its words fit, at least one
seed is met: no accepted place is missed, whatever its offset and wherever the edits stand. Where
they meet, the item is laid over the document at that place and compared word by word: fixed words
must be equal and slots of the same type, so a question asked anew with other numbers or names is
found, while a text that merely has the same shape is not (:func:`contaminated` says which values
must correspond). An item's first word has nothing before it that could make it a name or a unit,
so it fits its like in the document whether that was taken for a name, a unit or neither.

Everything is column functions. The seeds of a document meet those of the benchmark before anything
is shuffled; what goes on are places that met, each once with the words there.

Defined cases: a null or empty text has no seeds; documents with a null id are not judged
(:func:`drop_contaminated` keeps them); items shorter than ``size`` words are not looked for (take a
smaller ``size`` for those), nor are items without fixed words; repeated rows give the same pair
once; an empty table gives an empty result. Other columns are neither read nor returned, except that
:func:`drop_contaminated` passes all of them on.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import cut, texts

SIZE = 6
#: Fixed values: (words of a seed, stretch they lie in), the most selective first.
FAMILIES = ((4, 7), (3, 5), (2, 3), (1, 1))
#: Benchmark seeds up to this number (about 80 bytes each) are sent to all tasks; more are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "mile", "miles", "g", "kg", "mg",
         "lb", "lbs", "oz", "l", "ml", "litre", "litres", "liter", "liters", "s", "sec", "seconds",
         "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "dollars", "euros",
         "pounds", "cents", "percent", "degrees")
#: Marks that open a slot's token; what follows is its value.
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def valued(text: Column) -> Column:
    """Words of a text; a slot is its mark and its value.

    A name is a capitalised word after a lower-case word or a comma; a number a run of digits, with
    points and commas between them; a unit stands right after a number.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.translate(t, NUMBER + NAME + UNIT, "   ")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll},][\x20\x09-\x0D].)\p{Ll}+", NAME + "$0")
    t = F.regexp_replace(t, r"[0-9](?:[0-9]|[.,](?=[0-9]))*", f" {NUMBER}$0 ")
    t = F.translate(F.lower(t), PUNCTUATION, "")
    t = F.regexp_replace(t, rf"({NUMBER}[0-9]+[\x20\x09-\x0D]+)({'|'.join(UNITS)})"
                            r"(?![^\x20\x09-\x0D])", f"$1{UNIT}$2")
    return F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")


def template(words: Column) -> Column:
    """The words with every slot's value dropped."""
    return F.transform(words, lambda w: F.when(
        w < F.lit("\u0004"), F.substring(w, 1, 1)).otherwise(w))


def _hashes(shape: Column) -> Column:
    return F.transform(shape, lambda w: F.xxhash64(w))


def _turned(h: Column, k: int) -> Column:
    """The hash of a seed's word that stands ``k`` places after its first."""
    return h if k == 0 else F.shiftleft(h, 7 * k).bitwiseOR(F.shiftrightunsigned(h, 64 - 7 * k))


def _subsets(family: int) -> list[tuple[int, ...]]:
    """Places of the words of each seed of a family, counted from its first word."""
    k, stretch = FAMILIES[family]
    return [(0, *rest) for rest in combinations(range(1, stretch), k - 1)]


def _seeds_at(families: list[int]) -> Column:
    """The hash of every seed that starts at a place; r0, r1, ... are the turned hashes there."""
    return F.array(*[reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"r{k}") for k in places])
                     for f in families for places in _subsets(f)])


def _with_turned(rows: DataFrame, keep: list[str], families: list[int]) -> DataFrame:
    """Adds r0, r1, ...: turned hashes at ``at`` and the places after it; past the end 0."""
    width = max(FAMILIES[f][1] for f in families)
    return rows.select(*keep, *[
        _turned(F.coalesce(F.get("h", F.col("at") + k), F.lit(0).cast("long")), k).alias(f"r{k}")
        for k in range(width)])


def _family(n: Column, share: float, run: int) -> Column:
    """The first family of which an item of ``n`` words can't avoid every seed.

    Where no stretch of ``w`` words holds ``k`` that fit, at most k - 1 of each w fit.
    """
    least = F.ceil(F.lit(share) * n)
    out = F.lit(len(FAMILIES) - 1)
    for f in reversed(range(len(FAMILIES) - 1)):
        k, w = FAMILIES[f]
        avoided = (k - 1) * F.floor(n / w) + F.least(n % w, F.lit(k - 1))
        out = F.when((avoided < least) & F.lit(k <= run), F.lit(f)).otherwise(out)
    return out


def item_words(items: DataFrame, size: int, share: float, run: int) -> DataFrame:
    """(item_id, item, h, n, family): words of each item that is looked for and their hashes."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        valued(F.col("text").cast("string")).alias("item"))
    shape = template(F.col("item"))
    return (rows.filter("item_id IS NOT NULL").distinct()
            .filter((F.size(F.filter(shape, lambda w: w >= F.lit("\u0004"))) > 0)
                    & (F.size("item") >= size))
            .select("item_id", "item", _hashes(shape).alias("h"), F.size("item").alias("n"),
                    _family(F.size("item"), share, run).alias("family")))


def item_seeds(words: DataFrame, families: list[int]) -> DataFrame:
    """(item_id, n, at, w): every seed of each item, those at its first word in all its readings."""
    first = F.element_at("item", 1)
    fixed = first >= F.lit("\u0004")
    rest = F.slice("h", 2, F.col("n"))
    read = [F.col("h")]
    for mark in (NAME, UNIT):
        could = fixed if mark == NAME else fixed & first.isin(*UNITS)
        read.append(F.when(could, F.concat(F.array(F.xxhash64(F.lit(mark))), rest)))
    rows = words.select("item_id", "n", "family", F.explode(F.array_compact(
        F.array(*read))).alias("h"))
    rows = rows.select("item_id", "n", "family", "h", F.explode(
        F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    out = []
    for f in families:
        mine = _with_turned(rows.filter(F.col("family") == f), ["item_id", "n", "at"], [f])
        lasts = F.array(*[F.lit(places[-1]) for places in _subsets(f)])
        seed = F.explode(F.arrays_zip(_seeds_at([f]).alias("w"), lasts.alias("last"))).alias("s")
        out.append(mine.select("item_id", "n", "at", seed)
                   .filter(F.col("at") + F.col("s.last") < F.col("n"))
                   .select("item_id", "n", "at", F.col("s.w").alias("w")))
    return reduce(DataFrame.unionAll, out).distinct()


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, h): words of each text and the hashes of its template."""
    rows = texts(docs).filter("doc_id IS NOT NULL").select(
        "doc_id", valued(F.col("text")).alias("doc"))
    return rows.select("doc_id", "doc", _hashes(template(F.col("doc"))).alias("h"))


def document_seeds(words: DataFrame, keep: list[str], families: list[int]) -> DataFrame:
    """The ``keep`` columns with (doc_at, w) for every seed at every place of the texts."""
    rows = words.select(*keep, *[] if "h" in keep else ["h"],
                        F.posexplode("h").alias("at", "_h"))
    return (_with_turned(rows, [*keep, "at"], families)
            .select(*keep, F.col("at").alias("doc_at"), F.explode(_seeds_at(families)).alias("w")))


def _may_fit(share: float, run: int) -> Column:
    """Whether the hashes of templates laid over each other (mine, theirs) can reach a limit."""
    marks = [F.xxhash64(F.lit(m)) for m in (NAME, UNIT)]
    same = F.zip_with("mine", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = (F.col("start") >= 0) & F.coalesce(F.get("theirs", F.lit(0)).isin(*marks), F.lit(False))
    same = F.when(first, F.concat(F.array(F.lit(True)), F.slice(same, 2, F.greatest(
        F.size("mine") - 1, F.lit(0))))).otherwise(same)
    begin = F.struct(F.lit(0).alias("all"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, fits):
        now = F.when(fits, a["run"] + 1).otherwise(0)
        return F.struct((a["all"] + fits.cast("int")).alias("all"), now.alias("run"),
                        F.greatest(a["best"], now).alias("best"))
    return F.aggregate(same, begin, step, lambda a: (a["all"] >= F.lit(share) * F.col("n"))
                       | (a["best"] >= run))


def _compare(item: Column, doc: Column, lead: Column) -> Column:
    """Per place of the item: whether the document's word there fits, and both values of a slot.

    ``doc`` are the document's words from the item's place ``lead`` on.
    """
    def at(w, k):
        own = F.get(doc, k - lead)
        same = F.when(w < F.lit("\u0004"), F.substring(own, 1, 1) == F.substring(w, 1, 1)
                      ).otherwise((own == w) | ((k == 0) & (F.translate(own, NAME + UNIT, "") == w)))
        fits = F.coalesce(same & (k >= lead), F.lit(False))
        return F.struct(fits.alias("fits"), F.when(fits & (w < F.lit("\u0004")), w).alias("mine"),
                        F.when(fits & (w < F.lit("\u0004")), own).alias("theirs"))
    return F.transform(item, at)


def _longest_run(places: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, p):
        run = F.when(p["fits"], a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))
    return F.aggregate(places, start, step, lambda a: a["best"])


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = 0.6,
                 run: int = 13, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, start, n_item, n_matched, n_run, n_slots, n_renamed): items in documents.

    A pair counts where the slots are consistent and either ``share`` of the item's words or
    ``run`` words in a row fit. Of several places the one with the most matches is returned.
    """
    words = cut(item_words(items, size, share, run))
    families = sorted(r.family for r in words.select("family").distinct().collect()) or [0]
    seeds = cut(item_seeds(words, families))
    read = document_words(docs)
    start = (F.col("doc_at") - F.col("at")).alias("start")
    if seeds.count() <= broadcast_windows:
        met = document_seeds(read, ["doc_id", "doc", "h"], families).join(
            F.broadcast(seeds), "w").select("doc_id", "item_id", "n", start, "doc", "h")
        words = F.broadcast(words)
    else:
        met = (document_seeds(read, ["doc_id"], families).join(seeds, "w")
               .select("doc_id", "item_id", "n", start).distinct().join(read, "doc_id"))
    lead = F.greatest(-F.col("start"), F.lit(0))

    def part(c):
        return F.slice(c, F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n") - lead)
    met = met.select("doc_id", "item_id", "start", part("doc").alias("doc"),
                     part("h").alias("theirs")).distinct()
    whole = (met.join(words, "item_id")
             .withColumn("mine", F.slice("h", lead + 1, F.col("n") - lead))
             .filter(_may_fit(share, run))
             .select("doc_id", "item_id", "start", "item", "doc"))
    laid = whole.select(
        "doc_id", "item_id", "start", F.size("item").alias("n_item"),
        _compare(F.col("item"), F.col("doc"), lead).alias("places"))
    slots = F.filter("places", lambda p: p["mine"].isNotNull())
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(p["mine"], p["theirs"])))
    judged = laid.select(
        "doc_id", "item_id", "start", "n_item",
        F.size(F.filter("places", lambda p: p["fits"])).alias("n_matched"),
        _longest_run(F.col("places")).alias("n_run"), F.size(slots).alias("n_slots"),
        F.size(F.filter(pairs, lambda p: p["mine"] != p["theirs"])).alias("n_renamed"),
        F.size(pairs).alias("_pairs"),
        F.size(F.array_distinct(F.transform(slots, lambda p: p["mine"]))).alias("_mine"),
        F.size(F.array_distinct(F.transform(slots, lambda p: p["theirs"]))).alias("_theirs"))
    good = judged.filter((F.col("_pairs") == F.col("_mine"))
                         & (F.col("_pairs") == F.col("_theirs"))
                         & (F.col("n_matched") > F.col("n_slots"))
                         & ((F.col("n_matched") >= share * F.col("n_item"))
                            | (F.col("n_run") >= run)))
    best = good.groupBy("doc_id", "item_id").agg(F.min(F.struct(
        (-F.col("n_matched")).alias("m"), "start", "n_item", "n_matched", "n_run", "n_slots",
        "n_renamed")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n_item", "b.n_matched", "b.n_run",
                       "b.n_slots", "b.n_renamed")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    hit = contaminated(docs, items, **options).select(F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["_hit_id"], "left_anti")
