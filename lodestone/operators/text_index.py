"""Full-text and positional search as joins over a postings table.

:func:`save` writes the postings sorted by term, so that a search reads the few
row groups of its query terms; every search prunes to them before anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import glob
from ..functions.text import query_tokens, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", drop_numbers: bool = False, once: bool = False) -> DataFrame:
    """term, doc, freq, positions, doc_len, doc_terms: position and length count tokens after stop words.

    A row's postings are made within the row and go nowhere.  Where rows may share a document,
    those of one term and document are then put together; ``once`` says that no two rows do.
    """
    words = docs.select(F.col(doc).alias("doc"), tokens(F.col(text), drop_numbers).alias("words"))
    sized = words.select("doc", F.size("words").alias("doc_len"), F.size(F.array_distinct("words")).alias("doc_terms"), _places("words").alias("terms"))
    # Not inline, whose rows Spark filters by terms' size before: all of a row would be worked out twice.
    found = sized.select("doc", "doc_len", "doc_terms", F.inline_outer("terms")).where("term IS NOT NULL")
    each = found.select("term", "doc", "doc_len", "doc_terms", F.size("positions").cast("bigint").alias("freq"), "positions")
    if once:
        return each
    largest = [F.max(c).alias(c) for c in ("doc_len", "doc_terms")]
    return each.groupBy("term", "doc").agg(*largest, F.sum("freq").alias("freq"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def _places(words: str) -> Column:
    """Each different word with its places in order: words sorted with their places, cut where the word changes."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("position"))))

    def cut(at: Column) -> Column:
        starts = F.filter(F.transform(at, lambda x, i: i), lambda i: ~F.get(at, i)["term"].eqNullSafe(F.get(at, i - 1)["term"]))
        return _bound(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(at, i)["term"].alias("term"), _run(at, i, F.coalesce(F.get(s, k + 1), F.size(at))).alias("positions"))))

    return _bound(placed, cut)


def _run(at: Column, start: Column, end: Column) -> Column:
    return F.transform(F.slice(at, start + 1, end - start), lambda x: x["position"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a lambda's variable, since a column is put into a lambda's body as its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def save(index: DataFrame, path: str) -> None:
    """The postings in files of term ranges, sorted, so that a term's statistics prune the rest."""
    index.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def removed(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The postings without those of documents (column doc)."""
    return index.join(docs.select("doc").distinct(), "doc", "left_anti").select(*index.columns)


def updated(index: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings with documents added, or put in the place of those of the same name."""
    return removed(index, docs.select(F.col(doc).alias("doc"))).unionByName(postings(docs, doc, text))


def posting_list(index: DataFrame, term: str) -> DataFrame:
    """doc, freq, positions of one term, by document."""
    return index.where(F.col("term") == term.lower()).select("doc", "freq", "positions").orderBy("doc")


def document_stats(index: DataFrame, documents: int | None = None) -> DataFrame:
    """documents, terms (distinct), postings, tokens and average length; documents are those with a token, or as given.

    Counted from one plain aggregation by term and one by document, which Spark
    combines on the map side, instead of two distinct counts over expanded rows.
    """
    terms = index.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("freq").alias("tokens"))
    out = terms.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.sum("tokens").alias("tokens"))
    seen = F.lit(documents).cast("bigint") if documents is not None else index.select("doc").distinct().agg(F.count("doc")).scalar()
    return out.select(seen.alias("documents"), "terms", "postings", "tokens").withColumn("average_length", F.try_divide("tokens", "documents"))


def all_terms(index: DataFrame) -> DataFrame:
    return index.select("term").distinct().orderBy("term")


def search_any(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.where(F.col("term").isin(*terms)).select("doc").distinct()


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with every term; no terms, no documents."""
    wanted = sorted(set(terms))
    found = index.where(F.col("term").isin(*wanted)).groupBy("doc").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(wanted)).where(F.lit(bool(wanted))).select("doc")


def search(index: DataFrame, query: str) -> DataFrame:
    """Documents with all of the query's tokens."""
    return search_all(index, query_tokens(query))


def search_together(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with every term, which are lower-cased and not cleaned otherwise: a phrase search without positions."""
    return search_all(index, [t.lower() for t in terms])


def search_boolean(index: DataFrame, query: str) -> DataFrame:
    """AND, OR and NOT between words, AND binding closer than OR; a word alone is required."""
    found = None
    for part in _split(query.split(), "OR"):
        needed, barred = [], []
        for at, word in enumerate(part):
            if word.upper() in ("AND", "NOT"):
                continue
            (barred if at and part[at - 1].upper() == "NOT" else needed).extend(query_tokens(word))
        own = search_all(index, needed)
        if barred:
            own = own.join(search_any(index, barred), "doc", "left_anti")
        found = own if found is None else found.unionByName(own)
    return found.distinct() if found is not None else search_all(index, [])


def _split(words: list[str], mark: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w.upper() == mark:
            out.append([])
        else:
            out[-1].append(w)
    return [x for x in out if x]


def search_wildcard(index: DataFrame, pattern: str) -> DataFrame:
    """Documents with a term that the glob matches as a whole."""
    fits = F.col("term") == pattern if not set(pattern) & {"*", "?"} else glob(F.col("term"), pattern)
    return index.where(fits).select("doc").distinct()


def search_phrase(index: DataFrame, terms: list[str], max_distance: int = 1) -> DataFrame:
    """Terms in order: from each place of the first, every next term at its first later place, at most max_distance + 1 on.

    The chain is a fold over the position arrays of one document.
    """
    wanted = sorted(set(terms))
    if not wanted:
        return search_all(index, [])
    held = index.where(F.col("term").isin(*wanted)).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    held = held.where(F.size("at") == len(wanted))
    reach = F.col("at")[terms[0]]
    for term in terms[1:]:
        reach = _next_places(reach, F.col("at")[term], max_distance + 1)
    return held.where(F.size(reach) > 0).select("doc")


def _next_places(places: Column, later: Column, most: int) -> Column:
    """For each place the first later one, where it is near enough."""
    step = F.transform(places, lambda p: F.try_element_at(F.filter(later, lambda q: (q > p) & (q - p <= most)), F.lit(1)))
    return F.filter(step, lambda p: p.isNotNull())


search_proximity = search_phrase


def _matched(index: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the query's terms, with how often the query has each."""
    times = F.create_map(*[F.lit(x) for t in sorted(set(terms)) for x in (t, terms.count(t))])
    return index.where(F.col("term").isin(*sorted(set(terms)))).withColumn("times", times[F.col("term")])


def _with_df(found: DataFrame, terms: list[str]) -> DataFrame:
    """Document frequency of each query term: one row of counts over the same few postings, and no join."""
    wanted = sorted(set(terms))
    counts = found.agg(F.create_map(*[x for t in wanted for x in (F.lit(t), F.count_if(F.col("term") == t))])).scalar()
    return found.withColumn("df", counts[F.col("term")])


def rank_tfidf(index: DataFrame, documents: int, query: str, limit: int = 0) -> DataFrame:
    """doc, score: sum of idf / distinct terms of the document over the query's tokens, repeats counted; scores above 0 only."""
    terms = query_tokens(query)
    if not terms:
        return index.where("false").groupBy("doc").agg(F.sum(F.lit(0.0)).alias("score"), F.sort_array(F.collect_list("term")).alias("matched"))
    scored = _with_df(_matched(index, terms), terms)
    weight = F.ln(F.lit(float(documents)) / F.col("df")) / F.col("doc_len") * F.col("times")
    return _top(scored.groupBy("doc").agg(F.sum(weight).alias("score"), F.sort_array(F.collect_list("term")).alias("matched")), limit)


def rank_bm25(index: DataFrame, documents: int, average_length: float, terms: list[str], limit: int = 0) -> DataFrame:
    """doc, score by BM25 with ln((N - df + .5) / (df + .5)), which is negative for terms in most documents; scores above 0 only."""
    scored = _with_df(_matched(index, terms), terms)
    idf = F.ln((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("doc_len") / average_length))
    return _top(scored.groupBy("doc").agg(F.sum(idf * tf * F.col("times")).alias("score"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("matched")), limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    ordered = scored.where("score > 0").orderBy(F.desc("score"), "doc")
    return ordered.limit(limit) if limit else ordered
