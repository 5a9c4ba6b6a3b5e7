"""Lexical search over lines: postings, weights, scores, exact phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import EXPANSIONS, STOP_WORDS, is_test_path, length_norm, term_mask, term_weight, token_set, tokens, with_stems
from strandline.runtime import Scratch, spread

#: Points of a line for terms in it, for all of them, and for the literal query.
LINE_POINTS, SQUARE_POINTS, ALL_POINTS, LITERAL_POINTS = 80, 14, 120, 160
#: Points of a template's line, the weight of a rare term, and of one that tells something.
TEMPLATE_POINTS, RARE, LOW_SIGNAL = 18, 300, 124
#: Candidates kept, hits of a file in the first pass.
CANDIDATES, FIRST_PASS = 4_096, 3
#: Groups in which executors cut to the candidates.
GROUPS = 16


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, line, text): numbered from one."""
    return spread(docs).select(F.col(id_col).alias("file"), F.posexplode(F.split(text_col, "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def indexed(lines: DataFrame) -> DataFrame:
    """Lines with their sorted distinct tokens and stems, and the number of tokens (``length``)."""
    parted = lines.withColumn("_t", tokens(F.col("text")))
    return parted.withColumn("tokens", with_stems(F.col("_t"))).withColumn("length", F.size("_t")).drop("_t")


#: Symbols of a line that count, and kinds whose first line defines something.
LINE_SYMBOLS = 3
DEFINING = (
    "function", "method", "component", "class", "interface", "type", "constant", "getter", "setter", "ttl-shape", "ttl-term", "vue-prop", "vue-model", "vue-emit", "http-route", "http-endpoint",
)


def with_symbols(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """``index`` with the innermost three symbols around each line: their tokens, names and name tokens, and whether one is defined there."""
    from strandline.operators.intervals import _in_ranges

    own = nodes.filter("kind <> 'file'").select("file", "start_line", "end_line", "id", "name", "kind", "signature")
    # Of symbols with the same range, the first three alone can be among a line's; a line that comes again meets them once.
    same = Window.partitionBy("file", "start_line", "end_line").orderBy("id")
    own = own.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= LINE_SYMBOLS).drop("r")
    met = _in_ranges(index.select("file", "line").distinct(), own)
    w = Window.partitionBy("file", "line").orderBy(F.desc("start_line"), "id")
    three = met.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LINE_SYMBOLS).withColumn("_n", tokens(F.col("name"))).withColumn("_s", tokens(F.col("signature")))
    defines = (F.col("start_line") == F.col("line")) & (F.col("kind").isin(*DEFINING) | F.col("kind").startswith("terraform-"))
    found = three.groupBy("file", "line").agg(
        F.flatten(F.collect_list(F.array_union("_n", "_s"))).alias("_all"), F.collect_list(F.struct(F.lower("name").alias("name"), with_stems(F.col("_n")).alias("tokens"))).alias("symbols"),
        F.max(defines).alias("definition"), F.array_sort(F.collect_list("id")).alias("symbol_ids"),
    )
    found = found.withColumn("symbol_tokens", with_stems(F.col("_all"))).drop("_all")
    none = F.array().cast("array<string>")
    out = index.hint("merge").join(found, ["file", "line"], "left")
    return out.withColumns({"symbol_tokens": F.coalesce("symbol_tokens", none), "definition": F.coalesce("definition", F.lit(False)), "symbols": F.coalesce("symbols", F.array().cast("array<struct<name:string,tokens:array<string>>>")), "symbol_ids": F.coalesce("symbol_ids", none), "length": F.col("length") + F.size(F.coalesce("symbol_tokens", none))})


#: Code that a search reads, and the size from which structured files are left out.
STRUCTURED, STRUCTURED_BYTES = ("json", "yaml", "turtle"), 2 * 1024 * 1024


def searchable(files: DataFrame) -> DataFrame:
    """Those of ``files`` (path, language, content) that a search reads: no lock files, no large structured files, a known language."""
    lock = F.lower("path").rlike(r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|go\.sum|poetry\.lock|composer\.lock|gemfile\.lock)$")
    return files.filter((F.col("language") != "") & ~lock & ~(F.col("language").isin(*STRUCTURED) & (F.octet_length("content") > STRUCTURED_BYTES)))


def write_index(index: DataFrame, root: str) -> None:
    """The index as tables: lines with their tokens, and postings in ranges of tokens, so that a query reads its terms' rows alone."""
    index.write.mode("overwrite").parquet(f"{root}/lines")
    stored = index.sparkSession.read.parquet(f"{root}/lines")
    postings(stored).repartitionByRange("token").sortWithinPartitions("token", "file", "line").write.mode("overwrite").parquet(f"{root}/postings")
    stored.groupBy("file").agg(F.sum("length").alias("length")).write.mode("overwrite").parquet(f"{root}/files")


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, postings, files) as ``write_index`` left them."""
    return tuple(spark.read.parquet(f"{root}/{name}") for name in ("lines", "postings", "files"))


def matched_lines(found: DataFrame, terms: list[str]) -> DataFrame:
    """(file, line, mask, matches) of the lines that hold a term, from postings: the terms as bits, and their number."""
    some = found.filter(F.col("token").isin(*terms)).withColumn("bit", term_mask(F.array("token"), terms))
    return some.groupBy("file", "line").agg(F.bit_or("bit").alias("mask")).withColumn("matches", F.bit_count("mask"))


def postings(index: DataFrame) -> DataFrame:
    """(token, file, line): one row for each token of each line."""
    # The outer form keeps Catalyst from making the tokens a second time in a filter below the explode.
    return index.select(F.explode_outer("tokens").alias("token"), "file", "line").filter("token is not null")


def document_frequency(index: DataFrame) -> DataFrame:
    """(token, df): in how many files a token occurs; each file counts its tokens once before the shuffle by token."""
    return postings(index).select("token", "file").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _stem(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


#: Words that ask for the life of a request, and what such a query also looks for.
LIFECYCLE_CUES = set("after before dispatch exception error lifecycle middleware request response teardown".split())
LIFECYCLE_MUST = set("lifecycle request response teardown before after".split())
LIFECYCLE_TERMS = "context finalize full handle handler preprocess process response".split()
LIFECYCLE_MORE = {"exception": "error exception", "error": "error exception", "dispatch": "route view", "teardown": "cleanup close pop push signal"}


def lifecycle_terms(stems: set[str]) -> list[str]:
    """What a query about a life cycle also looks for; nothing for other queries."""
    if len(stems & LIFECYCLE_CUES) < 2 or not stems & LIFECYCLE_MUST:
        return []
    return LIFECYCLE_TERMS + [x for cue, more in LIFECYCLE_MORE.items() if cue in stems for x in more.split()]


def query_terms(query: str, expand: bool = True) -> list[str]:
    """Distinct stems of the query's words without stop words, and what they expand to, in order."""
    parted = re.sub("([a-z0-9])([A-Z])", r"\1 \2", query)
    parted = re.sub("([A-Za-z])([0-9])", r"\1 \2", parted)
    words = [w for w in re.findall("[a-z0-9]+", re.sub("([0-9])([A-Za-z])", r"\1 \2", parted).lower()) if w not in STOP_WORDS]
    out = [_stem(w) for w in words]
    if expand:
        out += [_stem(x) for w in words for x in EXPANSIONS.get(w, ())]
        out += [_stem(x) for x in lifecycle_terms({_stem(w) for w in words})]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Corpus:
    """What weights need: the number of files, their mean length, and each file's length."""

    files: int
    average: float


def measure(index: DataFrame) -> tuple[Corpus, DataFrame]:
    """(Corpus, (file, length)): lengths in raw tokens."""
    lengths = index.groupBy("file").agg(F.sum("length").alias("length"))
    row = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("a")).first()
    return Corpus(int(row["n"]), float(row["a"] or 0.0)), lengths


def weights(index: DataFrame, terms: list[str], files: int) -> dict[str, int]:
    """The weight of each term that occurs; one row for each query term reaches the driver."""
    held = index.select("file", F.array_intersect("tokens", F.array(*[F.lit(t) for t in terms])).alias("held"))
    df = held.select("file", F.explode_outer("held").alias("token")).filter("token is not null").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return {r["token"]: r["w"] for r in df.select("token", term_weight(F.lit(files), F.col("df")).alias("w")).collect()}


def _points(held: Column, weight: dict[str, int], least: int = 0) -> Column:
    """The sum of the weights, of ``least`` or more, of the terms in the array ``held``."""
    return sum((F.when(F.array_contains(held, t), w).otherwise(0) for t, w in sorted(weight.items()) if w >= least), F.lit(0))


def rare_cluster(held: Column, weight: dict[str, int]) -> Column:
    """For two rare terms or more together: 160 for the square of their number and half their weights, 900 at most."""
    count = sum((F.when(F.array_contains(held, t), 1).otherwise(0) for t, w in weight.items() if w >= RARE), F.lit(0))
    return F.when(count >= 2, F.least(F.lit(900), count * count * 160 + F.floor(_points(held, weight, RARE) / 2))).otherwise(0)


def coverage(in_file: Column, in_line: Column, weight: dict[str, int]) -> Column:
    """A quarter of the weights in the file and half of those that the line lacks, 500 at most."""
    return F.least(F.lit(500), F.floor(_points(in_file, weight) / 4) + F.floor(_points(F.array_except(in_file, in_line), weight) / 2))


def support_penalty(path: Column) -> Column:
    """What scripts, examples, fixtures and tests lose against sources."""
    low = F.lower(path)
    example = low.rlike(r"(^|/)(examples?|demo|samples)/")
    return F.when(low.startswith("scripts/"), 900).when(F.contains(low, F.lit("/scripts/")), 800).when(example, 3_000).when(low.rlike("benchmark|fixture|testdata/"), 650).when(is_test_path(path), 500).otherwise(0)


def path_score(path: Column, terms: list[str], weight: dict[str, int]) -> Column:
    """18 for each term in a path, 28 for each in its base name, shares of their weights, less the support penalty."""
    wanted = F.array(*[F.lit(t) for t in terms])
    in_path, in_base = (F.array_intersect(token_set(x), wanted) for x in (path, F.element_at(F.split(path, "/"), -1)))
    return F.size(in_path) * 18 + F.size(in_base) * 28 - support_penalty(path) + F.floor(_points(in_path, weight) / 8) + F.floor(_points(in_base, weight) / 5)


#: Points of a term in a symbol around the line, of any symbol, of a symbol that the query names, and their bound.
SYMBOL_POINTS, IN_SYMBOL, NAMED, SYMBOL_MATCH, MOST_OF_SYMBOL, MOST_NAMED = 34, 10, 520, 70, 240, 900
#: What a definition, or another line, gains or loses by what the reader prefers.
DEFINITION_GAIN, OTHER_LOSS, USAGE_GAIN, DEFINITION_LOSS = 420, 60, 180, 80


def symbol_score(in_symbol: Column, terms: list[str], query: str) -> Column:
    """Points of the symbols around a line: for terms in them, for symbols that the query names, whole or in words."""
    wanted = F.array(*[F.lit(t) for t in terms])
    whole = F.lit(query.lower())
    named = lambda x: (x["name"] != "") & (F.contains(whole, x["name"]) | ((F.size(x["tokens"]) >= 2) & (F.size(F.array_except(x["tokens"], wanted)) == 0)))
    n, size = F.size(in_symbol), F.size("symbol_tokens")
    boost = F.size(F.filter("symbols", named)) * NAMED + n * SYMBOL_MATCH + F.when((n >= 2) & (size > 0) & (n >= F.floor(size / 2)), MOST_OF_SYMBOL).otherwise(0)
    return n * SYMBOL_POINTS + F.when(F.size("symbols") > 0, IN_SYMBOL).otherwise(0) + F.least(F.lit(MOST_NAMED), boost)


def scored_lines(index: DataFrame, query: str, terms: list[str] | None = None, paths: bool = False, prefer: str | None = None) -> DataFrame:
    """(file, line, score, matches, text) of the lines that hold a term, by a sum of points.

    80 for each term in the line, 14 for the square of the number of terms at hand,
    the terms' weights times BM25's norm of the file's length, rare terms together,
    what else the file holds, 120 for all terms, 160 for the query itself, 18 for a
    line of a template.  An index ``with_symbols`` adds what ``symbol_score`` gives,
    and terms of the symbols are at hand; with ``paths``, the points of the file's
    path, whose terms are at hand.  ``prefer`` is ``definitions`` or ``usages``.  The
    index is written once and read for lengths, weights and lines.
    """
    terms = _asked(query, terms)
    return _scored(Scratch(index.sparkSession, "search").put("index", index), query, terms, paths, prefer)


def _asked(query: str, terms: list[str] | None = None) -> list[str]:
    terms = query_terms(query) if terms is None else terms
    if not terms:
        raise ValueError("the query has no terms")
    return terms


def _scored(index: DataFrame, query: str, terms: list[str], paths: bool, prefer: str | None) -> DataFrame:
    """``scored_lines`` of an index that is written."""
    symbols = "symbol_tokens" in index.columns
    if symbols:
        index = index.withColumn("_all", F.array_union("tokens", "symbol_tokens"))
    corpus, lengths = measure(index)
    weight = weights(index.withColumn("tokens", F.col("_all")) if symbols else index, terms, corpus.files)
    wanted = F.array(*[F.lit(t) for t in terms])
    none = F.array().cast("array<string>")
    hit = index.withColumn("in_line", F.array_intersect("tokens", wanted)).withColumn("in_symbol", F.array_intersect("symbol_tokens", wanted) if symbols else none)
    hit = hit.withColumn("in_path", F.array_intersect(token_set(F.col("file").cast("string")), wanted) if paths else none)
    hit = hit.filter((F.size("in_line") > 0) | (F.size("in_symbol") > 0)).withColumn("matched", F.array_union(F.array_union("in_line", "in_symbol"), "in_path")).drop("length")
    flags = [F.max(F.array_contains("matched", t)).alias(f"t{i}") for i, t in enumerate(terms)]
    whole = hit.groupBy("file").agg(*flags).select("file", F.array_compact(F.array(*[F.when(F.col(f"t{i}"), F.lit(t)) for i, t in enumerate(terms)])).alias("in_file"))
    met = hit.join(lengths, "file").join(whole, "file")
    n = F.size("matched")
    template = F.col("text").rlike("class=|@click=|v-if=|v-model=")
    score = (
        F.size("in_line") * LINE_POINTS
        + n * n * SQUARE_POINTS
        + F.floor(_points(F.col("matched"), weight).cast("double") * length_norm(F.col("length"), F.lit(corpus.average))).cast("int")
        + rare_cluster(F.col("matched"), weight)
        + coverage(F.col("in_file"), F.col("matched"), weight)
        + F.when(n == len(terms), ALL_POINTS).otherwise(0)
        + F.when(F.contains(F.lower("text"), F.lit(query.lower())), LITERAL_POINTS).otherwise(0)
        + F.when(template, TEMPLATE_POINTS).otherwise(0)
    )
    if symbols:
        score = score + symbol_score(F.col("in_symbol"), terms, query)
        if prefer == "definitions":
            score = score + F.when(F.col("definition"), DEFINITION_GAIN).otherwise(-OTHER_LOSS)
        elif prefer == "usages":
            score = score + F.when(F.col("definition"), -DEFINITION_LOSS).otherwise(USAGE_GAIN)
    if paths:
        score = score + path_score(F.col("file").cast("string"), terms, weight)
    return met.select("file", "line", score.cast("bigint").alias("score"), n.alias("matches"), "text")


def searched(index: DataFrame, query: str, limit: int = 10, paths: bool = False, prefer: str | None = None) -> tuple[list[tuple[object, int, int]], list[str]]:
    """(hits, warnings) of a search: no hits if all that matched is noise, a warning if the best line holds little of the query."""
    terms, scratch = _asked(query), Scratch(index.sparkSession, "search")
    index = scratch.put("index", index)
    scored = scratch.put("scored", _scored(index, query, terms, paths, prefer))
    best = scored.agg(F.max("matches").alias("m")).first()["m"]
    if best is None:
        return [], ["no line holds a term"]
    corpus, _ = measure(index)
    if low_signal(terms, weights(index, terms, corpus.files), best):
        return [], ["what matches is too common to tell anything"]
    return emit_hits(scored, limit), (["the best line holds less than half of the terms"] if low_confidence(terms, best) else [])


#: Kinds that have callers, symbols of a hit and relatives of a symbol that are shown.
CALLED, HIT_SYMBOLS, RELATIVES = ("function", "method", "class", "component", "getter", "setter", "http-route", "constant"), 2, 3


def hit_blast_radius(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(file, line, id, side, peers): callers, tests and callees, three each, of the two innermost symbols around each hit (file, line)."""
    from strandline.operators.intervals import _in_ranges

    own = nodes.filter(F.col("kind").isin(*CALLED)).select("file", "start_line", "end_line", "id")
    w = Window.partitionBy("file", "line").orderBy(F.desc("start_line"), "id")
    two = _in_ranges(hits.select("file", "line"), own).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= HIT_SYMBOLS).select("file", "line", "id")
    peers = nodes.select(F.col("id").alias("peer"), F.when(is_test_path(F.col("file")), "tests").otherwise("callers").alias("side"))
    calls = edges.filter("type = 'calls'").select("src", "dst").distinct()
    into = calls.join(two.select("id").distinct(), F.col("dst") == F.col("id")).select("id", F.col("src").alias("peer")).join(peers, "peer").select("id", "side", "peer")
    out = calls.join(two.select("id").distinct(), F.col("src") == F.col("id")).select("id", F.lit("callees").alias("side"), F.col("dst").alias("peer"))
    few = Window.partitionBy("id", "side").orderBy("peer")
    some = into.union(out).withColumn("r", F.row_number().over(few)).filter(F.col("r") <= RELATIVES).groupBy("id", "side").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
    return two.join(some, "id").select("file", "line", "id", "side", "peers")


def low_signal(terms: list[str], weight: dict[str, int], best_matches: int) -> bool:
    """Whether a result tells little: a term occurs nowhere, no line has two terms, and all that matched are common."""
    if best_matches > 1 or all(t in weight for t in terms) or not weight:
        return False
    return all(w < LOW_SIGNAL for w in weight.values())


def low_confidence(terms: list[str], best_matches: int) -> bool:
    """Whether the best line holds less than half of two terms or more."""
    return len(terms) >= 2 and best_matches * 2 < len(terms)


def top_lines(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The best lines: by score, file, line."""
    return scored.orderBy(F.desc("score"), "file", "line").limit(limit)


def candidates(scored: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The best lines as ``top_lines`` gives them; executors cut to ``limit`` in GROUPS groups first, as each task sends as many rows to the driver."""
    w = Window.partitionBy("_group").orderBy(F.desc("score"), "file", "line")
    some = scored.select("file", "line", "score").withColumn("_group", F.spark_partition_id() % GROUPS)
    some = some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).select("file", "line", "score")
    return top_lines(some.coalesce(GROUPS), limit)


def emit_hits(scored: DataFrame, limit: int = 10, context: int = 1) -> list[tuple[object, int, int]]:
    """(file, line, score) of hits that do not overlap, three of a file at most in a first pass, then the rest.

    Greedy by nature: it runs on the driver over at most CANDIDATES rows.
    """
    rows = [(r["file"], r["line"], r["score"]) for r in candidates(scored).collect()]
    taken: list[tuple[object, int, int]] = []
    for most in (FIRST_PASS, CANDIDATES):
        for file, line, score in rows:
            if len(taken) == limit:
                return taken
            near = [t for t in taken if t[0] == file]
            if len(near) < most and all(abs(line - t[1]) > 2 * context for t in near):
                taken.append((file, line, score))
    return taken


#: Weights of exact phrases.
PHRASE_WEIGHTS = {"quoted": 900, "route": 1_000, "mime": 800, "predicate": 850, "identifier": 700, "kebab": 700}


def exact_phrases(query: str) -> dict[str, int]:
    """Literals in a query that a line should hold as they stand, each with its weight."""
    out: dict[str, int] = {}

    def add(kind: str, found: str) -> None:
        out[found] = max(out.get(found, 0), PHRASE_WEIGHTS[kind])

    for quote in "\"'`":
        for x in re.findall(f"{quote}([^{quote}\n]{{2,}}){quote}", query):
            add("quoted", x)
    bare = re.sub("([\"'`])[^\"'`\n]{2,}\\1", " ", query)
    for word in bare.split():
        word = word.strip(".,;()?!")
        if re.fullmatch(r"(?:application|text|image|audio|video|font|multipart|model)/[\w.+-]+", word, re.I):
            add("mime", word)
        elif re.fullmatch(r"/[A-Za-z][\w\-./:]+", word):
            add("route", word)
        elif re.fullmatch(r"[A-Za-z][\w-]*:[A-Za-z][\w-]+", word):
            add("predicate", word)
        elif re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{7,}", word) and (word.strip("_").count("_") or len(re.findall("[A-Z]?[a-z0-9]+", word)) > 1):
            add("identifier", word)
        elif re.fullmatch(r"[A-Za-z_]\w*(?:-\w+)+", word):
            add("kebab", word)
    return out


def phrase_score(text: Column, phrases: dict[str, int]) -> Column:
    """The weights of the phrases that ``text`` holds, and 40 for the square of their number if there are several."""
    held = [F.when(F.contains(text, F.lit(p)), w).otherwise(0) for p, w in phrases.items()]
    count = sum((F.when(F.contains(text, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))
    return sum(held, F.lit(0)) + F.when(count > 1, count * count * 40).otherwise(0)


def inspect_exact(lines: DataFrame, query: str, most_lines: int = 25, most_files: int = 8) -> DataFrame:
    """(file, score, matched, first_line): files by the exact phrases of a query that their lines hold.

    A lone identifier in more than ``most_lines`` lines or ``most_files`` files tells nothing and gives no rows.
    """
    phrases = exact_phrases(query)
    if not phrases:
        raise ValueError("the query has no exact phrase")
    rows = lines.select("file", "line", F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight")) for p, w in phrases.items()]), lambda x: F.contains(F.col("text"), x["phrase"]))).alias("x"))
    rows = rows.select("file", "line", "x.phrase", "x.weight")
    if len(phrases) == 1:
        n = rows.agg(F.count(F.lit(1)).alias("l"), F.count_distinct("file").alias("f")).first()
        if n["l"] > most_lines or n["f"] > most_files:
            rows = rows.filter(F.lit(False))
    best = rows.groupBy("file", "phrase").agg(F.max("weight").alias("weight"), F.min("line").alias("line"))
    m = F.count(F.lit(1))
    return best.groupBy("file").agg((F.sum("weight") + m * m * 250).alias("score"), F.array_sort(F.collect_list("phrase")).alias("matched"), F.min("line").alias("first_line"))
