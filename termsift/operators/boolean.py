"""Boolean search over postings."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from termsift.cluster import join_lookup, may_broadcast, write_scratch
from termsift.functions.queries import (
    AND,
    AND_NOT,
    OR,
    SLOT_OF,
    Query,
    as_query,
    compile_queries,
    condition,
    fold,
)
from termsift.functions.words import term_prefix
from termsift.operators.doc_sets import bitmaps, may_broadcast_bitmaps, test_bits, write_ids
from termsift.sources.blocks import block_postings
from termsift.sources.index import filter_terms

#: Flags of search words in one bigint; the sign bit stays out.
_MASK_BITS = 63

#: Asked words up to which a document's are one bitmap of Spark's.
_DOCUMENT_BITS = 32_768


class Reach(NamedTuple):
    """What the counts of its words say about the result of a query."""

    rows: int  # postings of all its words
    n: int  # no more documents than this can match
    low: int | None  # and their ids lie between these bounds
    high: int | None
    cover: frozenset[str]  # every match contains one of these words


def reach(postings: DataFrame, query: str | Query) -> Reach:
    """Bound the result of a query from one row per search word, without computing it."""
    query = as_query(query)
    counted = filter_terms(postings, list(dict.fromkeys(query.words))).groupBy("term")
    counts = counted.agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    return _reach(counts.collect(), query)


def reach_blocks(blocks: DataFrame, query: str | Query) -> Reach:
    """The same from posting blocks, none of which is opened."""
    query = as_query(query)
    counted = filter_terms(blocks, list(dict.fromkeys(query.words))).groupBy("term")
    counts = counted.agg(
        F.sum("n").alias("n"), F.min("first_id").alias("low"), F.max("last_id").alias("high")
    )
    return _reach(counts.collect(), query)


def _reach(rows: list[Row], query: Query) -> Reach:
    total = sum(r["n"] for r in rows)
    known = {
        r["term"]: Reach(total, r["n"], r["low"], r["high"], frozenset([r["term"]])) for r in rows
    }
    none = Reach(total, 0, None, None, frozenset())

    def both(a: Reach, b: Reach) -> Reach:
        low, high = max(a.low, b.low), min(a.high, b.high)
        fewer = min(a, b, key=lambda r: r.n)
        return fewer._replace(low=low, high=high) if low <= high else none

    def either(a: Reach, b: Reach) -> Reach:
        cover = a.cover | b.cover
        low, high = min(a.low, b.low), max(a.high, b.high)
        return Reach(total, a.n + b.n, low, high, cover)

    return fold(
        query.postfix,
        lambda word: known.get(word, none),
        {
            AND: lambda a, b: both(a, b) if a.n and b.n else none,
            OR: lambda a, b: either(a, b) if a.n and b.n else a if a.n else b,
            AND_NOT: lambda a, b: a,
        },
    )


def _flags(hits: DataFrame, words: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    names = {word: f"t{i}" for i, word in enumerate(words)}
    seen = hits.groupBy("doc_id").agg(
        *[F.max(F.col("term") == word).alias(name) for word, name in names.items()]
    )
    return seen, {word: F.col(name) for word, name in names.items()}


def boolean_search(
    postings: DataFrame, query: str | Query, bounds: Reach | None = None
) -> DataFrame:
    """Documents that satisfy a query, ``(doc_id)``.

    One flag per search word and document, one shuffle, one condition. No document without any of
    the words can match, since ``not`` only ever narrows a left side.

    With ``bounds`` from ``reach``, a query whose matches must contain one of a few rare words
    keeps only the documents of those words before the shuffle, however common its other words.
    """
    query = as_query(query)
    words = list(dict.fromkeys(query.words))
    hits = filter_terms(postings, words)
    if bounds and bounds.n:
        hits = hits.where(F.col("doc_id").between(bounds.low, bounds.high))
        if may_broadcast(bounds.n) and not may_broadcast(bounds.rows):
            rare = filter_terms(hits, sorted(bounds.cover))
            common = filter_terms(hits, [word for word in words if word not in bounds.cover])
            ids = F.broadcast(rare.select("doc_id"))
            kept = common.join(ids, "doc_id", "left_semi")
            hits = rare.unionByName(kept)
    seen, flag = _flags(hits, words)
    return seen.where(condition(query.postfix, flag.__getitem__)).select("doc_id")


def blocks_of(
    blocks: DataFrame, doc_ids: DataFrame, words: list[str]
) -> DataFrame:
    """Blocks of some words that can hold one of the documents; the others are skipped unopened.

    The cuts of a term say which block an id lies in, so this is an equality join with the
    broadcast blocks of the ids. ``doc_ids`` must be of a checked size.
    """
    held = filter_terms(blocks, words)
    shifts = held.select("term", "shift").distinct().collect()  # one row per word
    if not shifts:
        return held
    cuts = F.array(
        *[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["shift"]).alias("shift")) for r in shifts]
    )
    wanted = doc_ids.select("doc_id", F.explode(cuts).alias("_cut"))
    block = "shiftright(doc_id, _cut.shift) AS _block"
    wanted = wanted.selectExpr("_cut.term AS term", block).distinct()
    held = held.withColumn("_block", F.expr("shiftright(first_id, shift)"))
    return held.join(F.broadcast(wanted), ["term", "_block"], "left_semi").drop("_block")


def boolean_search_blocks(
    blocks: DataFrame, query: str | Query, bounds: Reach | None = None
) -> DataFrame:
    """Documents that satisfy a query, ``(doc_id)``, from posting blocks.

    Blocks outside the bounds of the result are not read. Where every match must contain one of a
    few rare words, only blocks that can hold a document of these are opened for the other words.
    """
    query = as_query(query)
    words = list(dict.fromkeys(query.words))
    bounds = bounds or reach_blocks(blocks, query)
    if not bounds.n:
        return block_postings(blocks.limit(0)).select("doc_id")
    held = filter_terms(blocks, words)
    held = held.where((F.col("last_id") >= bounds.low) & (F.col("first_id") <= bounds.high))
    others = [word for word in words if word not in bounds.cover]
    if others and may_broadcast(bounds.n * len(others)) and 2 * bounds.n < bounds.rows:
        rare = block_postings(filter_terms(held, sorted(bounds.cover)))
        docs = write_ids(rare.select("doc_id"))
        common = block_postings(blocks_of(held, docs.ids, others))
        hits = rare.unionByName(common.join(F.broadcast(docs.ids), "doc_id", "left_semi"))
    else:
        hits = block_postings(held)
    seen, flag = _flags(hits.where(F.col("doc_id").between(bounds.low, bounds.high)), words)
    return seen.where(condition(query.postfix, flag.__getitem__)).select("doc_id")


def matched_terms(postings: DataFrame, words: list[str]) -> DataFrame:
    """Per document, the sorted list of the words it contains: ``(doc_id, terms)``."""
    words = sorted(set(words))
    seen, flag = _flags(filter_terms(postings, words), words)
    named = F.array(*[F.when(column, F.lit(word)) for word, column in flag.items()])
    return seen.select("doc_id", F.array_compact(named).alias("terms"))


def boolean_search_batch(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query of ``queries(query_id, query)`` at once: ``(query_id, doc_id)``.

    Queries that do not compile have no rows; ``compile_queries`` gives their errors.
    """
    compiled = compile_queries(queries.select("query_id", "query")).where("size(slots) > 0")
    # Compiled once: the words are measured, asked for and joined, and the plans joined.
    path = write_scratch(compiled.select("query_id", "words", "slots", "depth"), "compiled")
    compiled = compiled.sparkSession.read.parquet(path)
    plans = compiled.select("query_id", "slots")
    words = compiled.select("query_id", "depth", F.posexplode("words").alias("slot", "term"))
    words = words.withColumn("prefix", term_prefix(F.col("term")))
    size = words.agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("term")).alias("bytes"),
        F.max("slot").alias("widest"),
        F.max("depth").alias("deepest"),
    ).first()
    words = words.drop("depth")
    small = may_broadcast(size["n"], size["bytes"] or 0)
    # A long query of few words has a long plan.
    steps = plans.agg(F.count("*"), F.sum(F.size("slots"))).first()
    few_steps = may_broadcast(steps[0], 4 * (steps[1] or 0))

    # One bit per search word: the aggregate state and the shuffled rows have a fixed size. A
    # query of more words than bits has further columns.
    masks = [f"m{i}" for i in range((size["widest"] or 0) // _MASK_BITS + 1)]
    bits = [
        F.bit_or(
            F.expr(f"IF(slot DIV {_MASK_BITS} = {i}, shiftleft(1L, slot % {_MASK_BITS}), 0L)")
        ).alias(name)
        for i, name in enumerate(masks)
    ]
    keys = ["prefix", "term"]
    asked = words.select(keys).distinct()  # many queries may share few terms
    terms = asked.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    few_terms = may_broadcast(terms[0], terms[1] or 0)
    if few_terms:
        postings = postings.join(F.broadcast(asked), keys, "left_semi")
    # Every match of a query has one of its cover words: only these make candidates, and the other
    # words are looked up for the candidates, by term and document.
    counts = postings.groupBy(*keys).agg(F.count("*").alias("n"))
    counted = words.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    costs = F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda c: c["n"])
    covers = counted.groupBy("query_id").agg(costs.alias("costs")).join(plans, "query_id")
    path = write_scratch(covers.select("query_id", _cover().alias("cover")), "covers")
    covers = postings.sparkSession.read.parquet(path)
    words = counted.join(covers, "query_id").select(
        "query_id", "slot", *keys, "n", F.array_contains("cover", F.col("slot")).alias("covers")
    )
    path = write_scratch(words, "words")
    words = postings.sparkSession.read.parquet(path)
    if few_terms and terms[0] <= _DOCUMENT_BITS:
        depth = size["deepest"] or 0
        return _evaluate_documents(postings, words, plans, terms[0], depth, small, few_steps)
    first, others = (words.where(c).drop("covers", "n") for c in ("covers", "not covers"))
    found = join_lookup(postings, first, keys, small, salt_by="doc_id")
    path = write_scratch(found.select("query_id", "doc_id", "slot"), "candidates")
    found = postings.sparkSession.read.parquet(path)
    asked_of = found.select("query_id", "doc_id").distinct()
    asked_of = join_lookup(asked_of, others, ["query_id"], small, salt_by="doc_id")
    path = write_scratch(asked_of, "asked")
    asked_of = postings.sparkSession.read.parquet(path)
    postings = _of_candidates(postings, asked_of)
    more = asked_of.join(postings, [*keys, "doc_id"]).select("query_id", "doc_id", "slot")
    seen = found.union(more).groupBy("query_id", "doc_id").agg(*bits)
    planned = join_lookup(seen, plans, ["query_id"], few_steps, salt_by="doc_id")
    if len(masks) == 1:
        bit = f"(shiftright({masks[0]}, s) & 1L)"
    else:
        mask = f"array({', '.join(masks)})[s DIV {_MASK_BITS}]"
        bit = f"(shiftright({mask}, s % {_MASK_BITS}) & 1L)"
    holds = _postfix_holds(bit, size["deepest"] or 0)
    return planned.where(holds).select("query_id", "doc_id")


def _evaluate_documents(
    postings: DataFrame, words: DataFrame, plans: DataFrame, n_terms: int, depth: int, small: bool,
    few_steps: bool,
) -> DataFrame:
    """Candidates of the cover words, evaluated on one bitmap of asked words per document.

    ``postings`` are those of the asked words, ``words`` (query_id, slot, prefix, term, n, covers).
    Where cover words are the smaller part, only postings of documents with one of them are gathered
    by document, by a bitmap if it can be broadcast; candidates and documents are joined where they lie.
    """
    keys = ["prefix", "term"]
    spark = postings.sparkSession
    # as many rows as a bitmap has bits, at most
    number = (F.row_number().over(Window.orderBy(*keys)) - 1).alias("word")
    path = write_scratch(words.select(*keys).distinct().select(*keys, number), "numbers")
    numbers = spark.read.parquet(path)
    first = words.where("covers").drop("covers", "n")
    held = postings.join(F.broadcast(numbers), keys).select("doc_id", "word")
    by_term = words.groupBy(*keys).agg(F.first("n").alias("n"), F.max("covers").alias("covers"))
    total, cover = by_term.agg(F.sum("n"), F.sum(F.when(F.col("covers"), F.col("n")))).first()
    if 4 * (cover or 0) < (total or 0):
        covering = postings.join(F.broadcast(first.select(*keys).distinct()), keys, "left_semi")
        bits = bitmaps(covering)
        path = write_scratch(bits, "bitmaps")
        bits = spark.read.schema(bits.schema).parquet(path)
        if may_broadcast_bitmaps(bits.count()):
            held = test_bits(held, bits)
    # dealt before they are gathered, so that no task sends a bitmap for every document it has met
    bits = F.bitmap_construct_agg(F.col("word").cast("bigint")).alias("_bits")
    documents = held.repartition("doc_id").groupBy("doc_id").agg(bits)
    # the bitmap as numbers of 32 bits, its first byte being the highest of the first
    chunk = "cast(conv(hex(substring(_bits, 4 * k + 1, 4)), 16, 10) AS bigint)"
    chunks = F.expr(f"transform(sequence(0, {(n_terms - 1) // 32}), k -> {chunk})")
    documents = documents.select("doc_id", chunks.alias("_words"))
    found = join_lookup(postings, first.drop("slot"), keys, small, salt_by="doc_id")
    candidates = found.select("query_id", "doc_id").repartition("doc_id").distinct()
    by_slot = F.array_sort(F.collect_list(F.struct("slot", "word")))
    own = words.join(F.broadcast(numbers), keys).groupBy("query_id").agg(by_slot.alias("own"))
    plans = plans.join(own, "query_id").select(
        "query_id", "slots",
        F.expr("transform(own, w -> w.word DIV 32)").alias("_at"),
        F.expr("transform(own, w -> cast((3 - (w.word % 32) DIV 8) * 8 + w.word % 8 AS int))").alias("_shift"),
    )
    planned = join_lookup(
        candidates.join(documents, "doc_id"), plans, ["query_id"], few_steps, salt_by="doc_id"
    )
    bit = "(shiftright(_words[_at[s]], _shift[s]) & 1L)"
    return planned.where(_postfix_holds(bit, depth)).select("query_id", "doc_id")


def _of_candidates(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings that can be among ``asked`` (prefix, term, doc_id, ...), before any shuffle.

    Exactly those, by a bitmap of the documents asked for each word, where these can be broadcast; else
    those of the documents asked for any word, by one bitmap; else all of them.
    """
    keys = ["prefix", "term"]
    for by in (keys, []):
        bits = bitmaps(asked, *by)
        path = write_scratch(bits, "bitmaps")
        bits = asked.sparkSession.read.schema(bits.schema).parquet(path)
        text = sum((F.octet_length(key) for key in by), F.lit(0))
        rows, text_bytes = bits.agg(F.count("*"), F.sum(text)).first()
        if may_broadcast_bitmaps(rows, text_bytes or 0):
            return test_bits(postings, bits, *by)
    return postings


def _cover() -> Column:
    """Slots of words of which every match has one, the fewest postings by ``costs`` of each slot.

    A conjunction takes the cheaper side, a disjunction both, and what is excluded needs none.
    """
    left, right, rest = "st[size(st) - 2]", "st[size(st) - 1]", "slice(st, 1, size(st) - 2)"
    both = f"named_struct('n', {left}.n + {right}.n, 'c', array_union({left}.c, {right}.c))"
    start = "CAST(array() AS array<struct<n:bigint,c:array<int>>>)"
    return F.expr(
        f"""aggregate(slots, {start}, (st, s) -> CASE
            WHEN s >= 0 THEN array_append(st, named_struct('n', costs[s], 'c', array(s)))
            WHEN s = {SLOT_OF[AND]} THEN array_append({rest}, IF({left}.n <= {right}.n, {left}, {right}))
            WHEN s = {SLOT_OF[OR]} THEN array_append({rest}, {both})
            ELSE array_append({rest}, {left}) END)[0].c"""
    )


def _postfix_holds(bit: str, depth: int) -> Column:
    """Evaluate ``slots`` on one row, with a stack of truth values; ``bit`` is that of slot ``s``.

    The stack is the bits of a ``bigint`` where it fits, which is several times as fast as the
    array of booleans that serves deeper queries.
    """
    if depth <= _MASK_BITS:
        start, push = "0L", f"shiftleft(st, 1) | {bit}"
        top, below, rest = "st", "shiftright(st, 1)", "shiftleft(shiftright(st, 2), 1)"
        results = [f"{rest} | ({below} & {right} & 1L)" for right in (top, f"~{top}")]
        either, true = f"{rest} | (({below} | {top}) & 1L)", "= 1L"
    else:
        start, push = "CAST(array() AS array<boolean>)", f"array_append(st, {bit} = 1L)"
        top, below, rest = "st[size(st) - 1]", "st[size(st) - 2]", "slice(st, 1, size(st) - 2)"
        results = [f"array_append({rest}, {below} AND {right})" for right in (top, f"NOT {top}")]
        either, true = f"array_append({rest}, {below} OR {top})", "[0]"
    return F.expr(
        f"""aggregate(slots, {start}, (st, s) -> CASE
            WHEN s >= 0 THEN {push}
            WHEN s = {SLOT_OF[AND]} THEN {results[0]}
            WHEN s = {SLOT_OF[OR]} THEN {either}
            ELSE {results[1]} END) {true}"""
    )
