"""Line-run deduplication (operator 2), in DataFrame operations only.

All documents' lines in a row, by id, are one sequence; a line's place in it is its coordinate `g`. A class of depth h holds
the suffixes that share their first h lines, that is an interval of the suffix array with a common prefix of h at least,
and is named by its first member. Prefix doubling goes from depth h to 2h by the pair of names at g and g + h, keeps the
classes of more than one member, and ends when there are none.

The longest common prefix of each suffix with one that starts earlier (`lcp`) then follows from the largest step down to
one line: a suffix that stands in its class at depth d tries the name of the next 2^j lines. The members that share it
move to depth d + 2^j, but for their first one, which waits there as the earlier copy and goes on trying shorter steps
where it was. A suffix is in one class and waits in few, so the rows stay in the order of the lines.

A run g .. g + lcp is maximal if the line before does not start a run that reaches as far. Later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HAS_WORD, durable, named, split_join, with_row_key, without_lines

#: A single repeated line is a run too.
MIN_LINES = 1


def numbered_lines(rows: DataFrame) -> DataFrame:
    """`g`, `id`, `th`, `i`, `n1`, `n2`: the lines with a word, null ids first; i counts within a row, n1 and n2 hash.

    Repeated rows are one. Every row ends with a number that no line has, so that no run reaches into the next row.
    """
    hashes = F.transform(
        F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(HAS_WORD)),
        lambda x: F.struct(F.xxhash64(x).alias("n1"), F.xxhash64(F.lit(1), x).alias("n2")),
    )
    found = rows.select(F.col("__id").alias("id"), F.col("__th").alias("th"), hashes.alias("n")).where(F.size("n") > 0).dropDuplicates(["id", "th"])
    dealt = found.repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    ended = F.concat("n", F.array(F.struct(F.lit(None).cast("long").alias("n1"), F.lit(None).cast("long").alias("n2"))))
    each = dealt.select("id", "th", F.posexplode(ended).alias("i", "n")).withColumn("g", F.monotonically_increasing_id())
    return durable(each.select("g", "id", "th", "i", "n.n1", "n.n2")).where("n1 IS NOT NULL")


def _classes(members: DataFrame, keys: list[str]) -> DataFrame:
    """`g`, `c`: the members of classes of more than one, each with the first of its class."""
    names = members.groupBy(*keys).agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return durable(split_join(members, names, keys).select("g", F.col("first").alias("c")))


def prefix_classes(lines: DataFrame) -> list[DataFrame]:
    """The classes of depth 1, 2, 4, .. as long as one has more than one member."""
    levels, depth = [_classes(lines, ["n1", "n2"])], 1
    while not levels[-1].isEmpty():
        ahead = levels[-1].select((F.col("g") - depth).alias("g"), F.col("c").alias("c2"))
        levels.append(_classes(levels[-1].join(ahead, "g"), ["c", "c2"]))
        depth *= 2
    return levels[:-1]


def earlier_prefixes(lines: DataFrame) -> DataFrame:
    """`g`, `lcp`: how many lines from g on also stand in a row from an earlier place on, where that is one at least."""
    levels = prefix_classes(lines)
    if not levels:
        return lines.select("g", F.lit(0).cast("long").alias("lcp")).limit(0)
    state = levels[0].select("g", F.lit(0).cast("long").alias("lcp"), F.lit(-1).cast("long").alias("c"), F.lit(False).alias("waits"))
    for j in reversed(range(len(levels))):
        next_lines = levels[j].select(F.col("g").alias("at"), F.col("c").alias("name"))
        tried = state.withColumn("at", F.col("g") + F.col("lcp")).join(next_lines, "at", "left").drop("at")
        shared = tried.where("name IS NOT NULL").groupBy("lcp", "c", "name").agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        moved = split_join(tried, shared, ["lcp", "c", "name"], "left")
        goes = F.coalesce(F.col("first") < F.col("g"), F.lit(False))
        deeper = F.col("lcp") + (1 << j)
        placed = moved.select("g", F.when(goes, deeper).otherwise(F.col("lcp")).alias("lcp"), F.when(goes, F.col("first")).otherwise(F.col("c")).alias("c"), "waits")
        waiting = shared.select(F.col("first").alias("g"), deeper.alias("lcp"), F.col("first").alias("c"), F.lit(True).alias("waits"))
        state = durable(placed.unionByName(waiting))
    return state.where("NOT waits AND lcp > 0").select("g", "lcp")


def repeated_runs(rows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """`id`, `th`, `gone` (numbers of the lines to delete), `n_runs`, `longest_run` of the rows with a later copy."""
    lines = numbered_lines(rows)
    starts = earlier_prefixes(lines).where(F.col("lcp") >= min_lines).join(lines.select("g", "id", "th", "i"), "g")
    before = Window.partitionBy("id", "th").orderBy("i")
    reach = F.col("i") + F.col("lcp")
    inside = F.coalesce((F.lag("i").over(before) == F.col("i") - 1) & (F.lag(reach).over(before) == reach), F.lit(False))
    # of neighbouring starts each is one line further, so min_lines from each start cover the whole run
    span = F.sequence(F.col("i"), F.col("i") + min_lines - 1)
    return starts.withColumn("inside", inside).groupBy("id", "th").agg(
        F.array_distinct(F.flatten(F.collect_list(span))).alias("gone"), F.count_if(~F.col("inside")).alias("n_runs"), F.max("lcp").alias("longest_run")
    )


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """`__id`, `__th`, `n_lines`, `n_removed`, `n_runs`, `longest_run`, `kept` for every row.

    Lines are what "\\n" separates; lines without a word are never removed and do not break a run. A line goes if a run
    of min_lines lines around it also starts earlier (smaller id, or further up in the same row); runs are judged on the
    input. `n_runs` counts the maximal runs of min_lines lines or more that also start earlier, `longest_run` is the
    lines of the longest. Null text is empty and stays so. Null ids come first; rows that share an id are ordered by a
    hash of their text, and repeated rows are one document. Long texts are read whole, other columns not at all.
    """
    rows = with_row_key(docs, id_col, text_col)
    found = repeated_runs(rows, min_lines)
    joined = rows.join(found, rows["__id"].eqNullSafe(found["id"]) & (rows["__th"] == found["th"]), "left")
    kept = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(without_lines(F.col("__text"), F.col("gone")))
    n_lines = F.size(F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(HAS_WORD))).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("__id", "__th", n_lines.alias("n_lines"), zero(F.when(F.col("gone").isNotNull(), F.size("gone"))).alias("n_removed"), zero(F.col("n_runs")).alias("n_runs"), zero(F.col("longest_run")).alias("longest_run"), kept.alias("kept"))


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    done = deduplicate_lines(docs, id_col, text_col, min_lines)
    return done.select(F.col("__id").alias(id_col), "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """`docs` with the kept lines as text; a row that loses all its lines goes, other rows and columns, whatever their
    names, stay."""
    done = deduplicate_lines(docs, id_col, text_col, min_lines).where("n_removed > 0").distinct()
    done = done.select(F.col("__id").alias("i"), F.col("__th").alias("t"), "kept", (F.col("n_removed") < F.col("n_lines")).alias("some"))
    rows = docs.select(*[named(c).alias(f"c{n}") for n, c in enumerate(docs.columns)])
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    joined = rows.join(done, key.eqNullSafe(F.col("i")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("t")), "left").where("some IS NULL OR some")
    whole: list[Column] = [F.coalesce(F.col("kept"), text) if c == text_col else F.col(f"c{n}") for n, c in enumerate(docs.columns)]
    return joined.select(*[x.alias(c) for x, c in zip(whole, docs.columns, strict=True)])


#: From the definition, one line deeper at a time: the prefixes that more than one place has, and whether one is earlier.
ORACLE_SQL = r"""
    WITH RECURSIVE l AS (SELECT doc_id, p, string_split(coalesce(text, ''), chr(10))[p] AS line
               FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(p)),
    worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    deep AS (SELECT doc_id, i, 1 AS d, md5(line) AS k, count(*) OVER w AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS later FROM worded WINDOW w AS (PARTITION BY line)
             UNION ALL
             SELECT doc_id, i, d, k, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later
             FROM (SELECT a.doc_id, a.i, a.d + 1 AS d, md5(a.k || b.line) AS k FROM deep a JOIN worded b ON b.doc_id = a.doc_id AND b.i = a.i + a.d WHERE a.n > 1)),
    lcp AS (SELECT doc_id, i, max(d) AS d FROM deep WHERE later GROUP BY 1, 2),
    heads AS (SELECT *, coalesce(lag(i) OVER w = i - 1 AND lag(i + d) OVER w = i + d, false) AS inside FROM lcp WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    found AS (SELECT doc_id, count(*) FILTER (NOT inside) AS n_runs, max(d) AS longest_run FROM heads GROUP BY 1),
    lost AS (SELECT doc_id, p, true AS lost FROM worded JOIN lcp USING (doc_id, i)),
    text AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (lost IS NULL) AS kept, count(lost) AS n_removed FROM l LEFT JOIN lost USING (doc_id, p) GROUP BY 1),
    n AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY 1)
    SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest_run, 0)::BIGINT AS longest_run,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM text LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)"""
