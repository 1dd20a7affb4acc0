"""Lines, segments and n-grams of read text, as array expressions and explodes without shuffles.

Explodes of costly arrays are outer ones with a filter behind them: of an inner one the optimiser derives a filter on
the array's size, which works the array out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.functions import text as X

LINE = "struct<text:string,conf:double,box:array<int>,line_num:int>"


def unpivot_variants(df: DataFrame, variants: list[str], fields: list[str], key: str = "image_id") -> DataFrame:
    """Wide ``{variant}_{field}`` columns as rows (key, variant, seq, fields); variants with blank text are left out.
    Columns that are missing count as NULL."""
    have = set(df.columns)
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("seq"), *[(F.col(f"`{v}_{f}`") if f"{v}_{f}" in have else F.lit(None)).cast("string").alias(f) for f in fields]) for i, v in enumerate(variants)])
    out = df.select(key, F.explode(rows).alias("v")).select(key, "v.*")
    return out.where(F.coalesce(F.trim(F.col("text")) != "", F.lit(False)))


def text_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_index, text): lines of a text that aren't blank; the index counts blank ones too."""
    return df.select(key, F.posexplode(F.split(F.col(column), "\n")).alias("line_index", "line")).select(key, "line_index", X.strip(F.col("line")).alias("text")).where("text <> ''")


def json_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_index, text, conf, box) of a JSON list of lines, bare or under ``lines``; broken JSON gives no row.
    ``line_num`` is the index where it is given, else the place in the list."""
    c = F.col(column)
    bare = F.from_json(c, f"array<{LINE}>")
    under = F.from_json(c, f"struct<lines:array<{LINE}>>")["lines"]
    lines = F.when(F.trim(c).startswith("["), bare).when(F.trim(c).startswith("{"), under)
    out = df.select(key, F.posexplode(lines).alias("pos", "l"))
    return out.where("l is not null and trim(l.text) <> ''").select(key, F.coalesce("l.line_num", "pos").alias("line_index"), "l.text", "l.conf", "l.box")


def split_segments(c: Column) -> Column:
    """Ordered distinct segments of a line: split at brackets and separators; a segment with pluses also gives its
    parts and each two neighbouring parts joined."""
    bars = F.regexp_replace(F.regexp_replace(c, r"[()\[\]{}]", " | "), r"[|/:;,•‣◦⁃∙·]+", "|")
    parts = F.filter(F.transform(F.split(bars, r"\|"), X.strip), lambda p: p != "")

    def with_pluses(p: Column) -> Column:
        bits = F.filter(F.transform(F.split(p, r"\s*\+\s*"), X.strip), lambda b: b != "")
        pairs = F.when(F.size(bits) > 1, F.transform(F.sequence(F.lit(1), F.size(bits) - 1), lambda i: F.concat_ws(" + ", F.element_at(bits, i), F.element_at(bits, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.when(p.contains("+"), F.concat(F.array(p), bits, pairs)).otherwise(F.array(p))

    return F.array_distinct(F.flatten(F.transform(parts, with_pluses)))


def ngrams(c: Column, low: int, high: int) -> Column:
    """All n-grams (start, n, text) of a token array, n from ``low`` to ``high``."""
    size = F.size(c)

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size - n), lambda s: F.struct(s.alias("start"), n.alias("n"), F.array_join(F.slice(c, s + 1, n), " ").alias("text")))

    top = F.least(F.lit(high), size)
    return F.when(size >= low, F.flatten(F.transform(F.sequence(F.lit(low), top), of))).otherwise(F.array().cast("array<struct<start:int,n:int,text:string>>"))


def ngrams_across(c: Column, place: Column, low: int, high: int) -> Column:
    """Those n-grams of a token array that begin before ``place`` and end behind it."""
    size = F.size(c)

    def of(n: Column) -> Column:
        first, last = F.greatest(F.lit(0), place - n + 1), F.least(place - 1, size - n)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), n.alias("n"), F.array_join(F.slice(c, s + 1, n), " ").alias("text")))

    top = F.least(F.lit(high), size)
    return F.when(size >= low, F.flatten(F.transform(F.sequence(F.lit(low), top), of))).otherwise(F.array().cast("array<struct<start:int,n:int,text:string>>"))


def cross_line_ngrams(lines: DataFrame, by: list[str], low: int = 2, high: int = 6, most_tokens: int = 60) -> DataFrame:
    """N-grams over two consecutive lines that cross the break between them: (by, line_index, start, n, text), the first
    of each key kept. ``lines`` has ``by``, ``line_index`` (order) and ``text``; windows of more tokens are skipped,
    since no listed name is that long."""
    w = Window.partitionBy(*by).orderBy("line_index")
    a = lines.withColumn("__t", X.tokens(F.col("text"))).withColumn("__next", F.lead("__t").over(w))
    a = a.where(F.col("__next").isNotNull() & (F.size("__t") > 0) & (F.size("__next") > 0)).withColumn("__b", F.size("__t")).withColumn("__all", F.concat("__t", "__next")).where(F.size("__all") <= most_tokens)
    g = a.select(*by, "line_index", "__b", F.explode_outer(ngrams_across(F.col("__all"), F.col("__b"), low, high)).alias("g")).where("g is not null")
    g = g.select(*by, "line_index", F.col("g.start").alias("start"), F.col("g.n").alias("n"), F.col("g.text").alias("text")).withColumn("__key", X.key(F.col("text")))
    first = Window.partitionBy(*by, "__key").orderBy("line_index", "n", "start")
    return g.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__key")


def product_items(c: Column) -> Column:
    """Items of a name joined by `` + ``."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\s+", " "), r"\s+\+\s+"), X.strip), lambda x: x != "")


def product_surfaces(df: DataFrame, name: str) -> DataFrame:
    """(surface, surface_class, n_items) for each name: the full name, and each item where there are several."""
    items = product_items(F.col(name))
    full = F.array(F.struct(X.strip(F.regexp_replace(F.col(name), r"\s+", " ")).alias("surface"), F.lit("full").alias("surface_class"), F.size(items).alias("n_items")))
    atoms = F.when(F.size(items) > 1, F.transform(items, lambda x: F.struct(x.alias("surface"), F.lit("atomic").alias("surface_class"), F.lit(1).alias("n_items")))).otherwise(F.array().cast("array<struct<surface:string,surface_class:string,n_items:int>>"))
    return df.where(F.trim(F.col(name)) != "").select(*[c for c in df.columns], F.inline(F.concat(full, atoms)))


def best_windows(lines: DataFrame, key: str, column: str, widths: tuple[int, int]) -> DataFrame:
    """All windows of ``widths[0]`` to ``widths[1]`` tokens of a text: (key, start, n, text)."""
    g = ngrams(X.tokens(F.col(column)), *widths)
    return lines.select(key, F.explode_outer(g).alias("g")).where("g is not null").select(key, "g.*")


def assemble_lines(words: DataFrame, by: list[str], line: list[str], order: str, text: str, conf: str, least_conf: float = 0.0, box: str | None = None) -> DataFrame:
    """Words of a reader as lines: text joined in ``order``, mean confidence, number of words, and with ``box`` the box around
    all of them. Blank words and those below ``least_conf`` or 0 are left out.

    Each group is one line of a page, which bounds it."""
    g = words.where((F.trim(F.col(text)) != "") & (F.col(conf) >= max(0.0, least_conf))).groupBy(*by, *line)
    around = [X.union_box(F.filter(F.collect_list(F.col(box)), lambda b: F.size(b) == 4)).alias("box")] if box else []
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"), F.round(F.avg(conf), 6).alias("conf"), F.count("*").alias("n_words"), *around)


def reading_order(items: DataFrame, by: list[str], box: str, seq: str) -> DataFrame:
    """``items`` with ``line_num`` from 0: by top, then left edge of the box, items without one last, ties by ``seq``. A page
    bounds the window."""
    w = Window.partitionBy(*by).orderBy(F.col(box)[1].asc_nulls_last(), F.col(box)[0].asc_nulls_last(), seq)
    return items.withColumn("line_num", F.row_number().over(w) - 1)
