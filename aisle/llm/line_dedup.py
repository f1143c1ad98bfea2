"""Line deduplication by a tree of line templates.

A line goes down a tree of fixed depth: first by its number of tokens, then by its first
three tokens. A shorter line, and a line in a script without blanks, is a leaf of its own. Tokens with
a digit are variable fields from the start. In the leaf that it reaches, a token that few lines of
documents have at its place is a variable field too. What remains is the line's template,
if enough of its tokens are constant. Templates that recur in many different documents are
boilerplate: their lines go, except in the first document that has one.

All on DataFrame functions. Leaves and lines are known by two 64-bit hashes together; texts
are read for one line of each kind, and only in leaves that hold more than one kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import cut_lineage, spare

#: Leading tokens that the tree branches on.
LEADING = 3
#: Different documents that make a template recurring; lines of documents that make a token a constant of its place.
LEAST_DOCUMENTS = 10
#: Share of a line's tokens that must be constant.
CONSTANT_SHARE = 0.7

#: Runs of blanks that are not a single space; a single one stays as it is.
BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
NUMBERED = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
FIELD = "<*>"


def _lines(text: Column) -> Column:
    """Lines with blanks folded and tokens that hold a digit replaced by the field mark."""
    masked = lambda line: F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, NUMBERED, FIELD)).otherwise(line)
    folded = F.regexp_replace(text, BLANKS, " ")
    return F.transform(F.split(folded, "\n", -1), lambda line: masked(F.btrim(line, F.lit(" "))))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _fields(line: Column) -> Column:
    """How many tokens of a line are fields."""
    listed = F.size(F.filter(F.split(line, " "), lambda t: t == FIELD))
    return F.when(F.contains(line, F.lit(FIELD)), listed).otherwise(0)


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, body, no, leaf, line, firm): every line with a token, by hashes; ``body`` stands for the text.

    ``firm`` lines are constant enough as they stand.
    """
    found = F.filter(
        F.transform(
            _lines(F.col("text")),
            lambda line, no: F.when(
                line != "",
                F.struct(
                    no.alias("no"),
                    F.xxhash64(_tokens(line), F.substring_index(line, " ", LEADING)).alias("leaf"),
                    F.xxhash64(line).alias("line"),
                    (_tokens(line) - _fields(line) >= CONSTANT_SHARE * _tokens(line)).alias("firm"),
                ),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    return docs.select("doc_id", F.xxhash64("text").alias("body"), F.explode(found).alias("e")).select("doc_id", "body", "e.*")


def _recurring(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (leaf, line, first): lines of recurring templates and the first document that has the template."""
    once = placed.groupBy("leaf", "line", "doc_id", "body").agg(F.min("no").alias("no"), F.first("firm").alias("firm"))
    kinds = once.groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "body", "no")).alias("at"), F.first("firm").alias("firm")
    )
    kinds = cut_lineage(kinds, "kinds")
    # Lines in many documents are templates as they stand; others may become one in a leaf with company.
    leaves = kinds.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("kinds"))
    crowded = leaves.where((F.col("docs") >= LEAST_DOCUMENTS) & (F.col("kinds") > 1)).select("leaf")
    wanted = kinds.join(crowded, "leaf", "left_semi").select("leaf", "line", "docs", "first", "at.doc_id", "at.body", "at.no")
    wanted = cut_lineage(wanted, "wanted")
    by_doc = wanted.groupBy("doc_id", "body").agg(F.collect_set("no").alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    # The list grows with the corpus, so it is merged with the texts and never sent to all tasks.
    texts = texts.join(by_doc.hint("merge"), texts["id"].eqNullSafe(by_doc["doc_id"]) & (texts["text_hash"] == by_doc["body"]))
    picked = texts.select("wanted", _lines(F.col("text")).alias("lines"))
    picked = picked.select(F.explode(F.transform("wanted", lambda no: F.get("lines", no))).alias("words")).distinct()
    picked = picked.select(
        "words",
        F.xxhash64(_tokens(F.col("words")), F.substring_index("words", " ", LEADING)).alias("leaf"),
        F.xxhash64("words").alias("line"),
    )
    lines = cut_lineage(wanted.select("leaf", "line", "docs", "first").join(picked, ["leaf", "line"]), "lines")
    places = lines.select("leaf", "line", "docs", F.posexplode(F.split("words", " ")).alias("place", "token"))
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("all"))
    common = common.where((F.col("all") >= LEAST_DOCUMENTS) & (F.col("token") != FIELD)).drop("all").withColumn("constant", F.lit(True))
    marked = places.join(common, ["leaf", "place", "token"], "left")
    shown = F.when(F.col("constant"), F.col("token")).otherwise(FIELD)
    templates = marked.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("place", shown.alias("token")))).alias("parts"),
        F.avg(F.coalesce("constant", F.lit(False)).cast("int")).alias("share"),
    )
    templates = templates.where(F.col("share") >= CONSTANT_SHARE)
    named = lines.join(templates.select("leaf", "line", F.col("parts.token").alias("template")), ["leaf", "line"])
    named = named.select("leaf", "line", "docs", "first", F.sha2(F.array_join("template", " "), 256).alias("template"))
    named = cut_lineage(named, "named")
    sums = named.groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.count(F.lit(1)).alias("lines"))
    sums = sums.where(F.col("docs") >= LEAST_DOCUMENTS)
    # A document may hold several lines of a template: documents are told apart before they are counted.
    open_ = named.join(sums.where("lines > 1").select("leaf", "template"), ["leaf", "template"]).select("leaf", "line", "template")
    holders = placed.select("leaf", "line", "doc_id", "body").join(open_, ["leaf", "line"]).groupBy("leaf", "template", "doc_id", "body").agg(F.lit(1).alias("one"))
    enough = holders.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("leaf", "template")
    enough = enough.unionByName(sums.where("lines = 1").select("leaf", "template"))
    counted = sums.select("leaf", "template", "first").join(enough, ["leaf", "template"])
    by_template = named.select("leaf", "line", "template").join(counted, ["leaf", "template"]).select("leaf", "line", "first")
    alone = kinds.where((F.col("docs") >= LEAST_DOCUMENTS) & F.col("firm")).select("leaf", "line", "first")
    both = by_template.unionByName(alone).groupBy("leaf", "line").agg(F.min("first").alias("first"))
    return cut_lineage(both, "recurring")


def _with_drops(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` and the numbers of the lines to drop, null where there are none."""
    placed = cut_lineage(_placed(docs), "placed")
    recurring = _recurring(docs, placed)
    hits = placed.join(recurring, ["leaf", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    drops = hits.groupBy("doc_id", "body").agg(F.collect_set("no").alias("drops"))
    names = {c: spare(docs, c) for c in ("drop_id", "drop_body", "drops")}
    drops = drops.toDF(names["drop_id"], names["drop_body"], names["drops"])
    joined = docs.join(
        drops,
        docs["doc_id"].eqNullSafe(drops[names["drop_id"]]) & (F.xxhash64(docs["text"]) == drops[names["drop_body"]]),
        "left",
    )
    return joined.drop(names["drop_id"], names["drop_body"]), names["drops"]


def _cleaned(drops: str) -> Column:
    lines = F.split("text", "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    return F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the lines of recurring templates.

    Cases: a null text stays null and an empty one empty; a text of which every line goes is
    empty, its row stays; a line of one or two tokens is a template by its exact text; of the documents that share
    a template the one of smallest doc_id keeps its lines, a null id only where there is no
    other; rows that repeat id and text count once and are treated alike; an empty table gives no
    rows; columns of any name are handed through.
    """
    joined, drops = _with_drops(docs)
    return joined.withColumn("text", _cleaned(drops)).select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, text) for every row; cases as in ``drop_lines``, a null text has no lines."""
    joined, drops = _with_drops(docs.select("doc_id", "text"))
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col(drops).isNull(), 0).otherwise(F.size(drops)).cast("long").alias("n_dropped"),
        _cleaned(drops).alias("text"),
    )


def oracle() -> str:
    """DuckDB text of ``line_report``, on the strings themselves; ids are taken as unique."""
    return rf"""
    WITH raw AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
    ), masked AS (
      SELECT doc_id, no, own,
        trim(regexp_replace(regexp_replace(own, '{BLANKS}', ' ', 'g'), '{NUMBERED}', '{FIELD}', 'g'), ' ') AS line
      FROM raw
    ), placed AS (
      SELECT *, string_split(line, ' ') AS t, len(string_split(line, ' ')) AS n FROM masked WHERE line <> ''
    ), leafed AS (
      SELECT *, n || ' ' || array_to_string(t[1:{LEADING}], ' ') AS leaf FROM placed
    ), kinds AS (
      SELECT leaf, line, any_value(t) AS t, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM leafed GROUP BY ALL
    ), crowded AS (
      SELECT leaf FROM kinds GROUP BY leaf HAVING sum(docs) >= {LEAST_DOCUMENTS} AND count(*) > 1
    ), places AS (
      SELECT leaf, line, docs, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM kinds WHERE leaf IN (SELECT leaf FROM crowded)
    ), common AS (
      SELECT leaf, place, token FROM places WHERE token <> '{FIELD}' GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}
    ), templates AS (
      SELECT p.leaf, p.line, string_agg(CASE WHEN c.token IS NULL THEN '{FIELD}' ELSE p.token END, ' ' ORDER BY p.place) AS template
      FROM places p LEFT JOIN common c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token
      GROUP BY p.leaf, p.line HAVING avg((c.token IS NOT NULL)::INT) >= {CONSTANT_SHARE}
    ), named AS (
      SELECT k.leaf, k.line, k.docs, k.first, template FROM kinds k JOIN templates USING (leaf, line)
    ), counted AS (
      SELECT n.leaf, template, min(n.first) AS first FROM named n JOIN leafed l ON l.leaf = n.leaf AND l.line = n.line
      GROUP BY n.leaf, template HAVING count(DISTINCT l.doc_id) >= {LEAST_DOCUMENTS}
    ), recurring AS (
      SELECT leaf, line, min(first) AS first FROM (
        SELECT leaf, line, c.first FROM named JOIN counted c USING (leaf, template)
        UNION ALL SELECT leaf, line, first FROM kinds
        WHERE docs >= {LEAST_DOCUMENTS} AND len(list_filter(t, lambda x: x <> '{FIELD}')) >= {CONSTANT_SHARE}::DOUBLE * len(t)
      ) GROUP BY ALL
    ), gone AS (
      SELECT DISTINCT doc_id, no FROM leafed JOIN recurring USING (leaf, line) WHERE doc_id IS DISTINCT FROM first
    ), kept AS (
      SELECT r.doc_id, count(*) AS n_lines, count(g.no) AS n_dropped,
        coalesce(string_agg(r.own, chr(10) ORDER BY r.no) FILTER (WHERE g.no IS NULL), '') AS text
      FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.no = g.no GROUP BY r.doc_id
    )
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, k.text
    FROM documents d LEFT JOIN kept k USING (doc_id)
    """
