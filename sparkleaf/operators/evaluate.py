"""Evaluation of parsed against labelled nodes: matching, confusion matrix, accuracies, edges, recall.

Nodes: (doc_id, ordinal, order_num, page_num (-1: any), layout_type, text, box). Labels and parser nodes are two tables.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

# Label types.
LABELS = ["Text", "Title", "List", "Catalog", "Table", "Figure", "Formula", "Code", "FigureName", "FigureNote", "TableName", "TableNote"]


def similarity(a: str, b: str) -> float:
    """Twice the matched characters over both lengths, of the longest common blocks."""
    short, long = sorted((a, b), key=len)
    return SequenceMatcher(None, short, long).ratio()


def _match(labels: pd.DataFrame, parsed: pd.DataFrame, threshold: float) -> list[tuple]:
    free = [(node, Counter(node.clean)) for node in parsed.sort_values("ordinal").itertuples(index=False)]
    out = []
    for label in labels.sort_values("ordinal").itertuples(index=False):
        found, score, n, letters = [], 0.0, len(label.clean), Counter(label.clean)
        for at, (node, others) in enumerate(free):
            if label.page_num != -1 and node.page_num != -1 and label.page_num != node.page_num:
                continue
            m = len(node.clean)
            least = (threshold - 0.006) * (n + m)  # no ratio can exceed what lengths, or characters in common, allow
            near = n + m == 0 or (2 * min(n, m) >= least and 2 * sum(min(k, others[c]) for c, k in letters.items()) >= least)
            ratio = 1.0 if label.clean == node.clean else round(similarity(label.clean, node.clean), 2) if near else 0.0
            if near and ratio >= threshold:
                found.append(node.order_num)
                score = ratio
                del free[at]
                break
            if label.clean in node.clean or node.clean in label.clean:
                found.append(node.order_num)
        out += [(label.order_num, x, score, i) for i, x in enumerate(found)] or [(label.order_num, None, 0.0, 0)]
    return out


def mapping(labels: DataFrame, parsed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, label, parsed, score, no): greedy matches of each label in order; an unmatched label has one row with null.

    A node of similarity 0.8 (rounded to two digits) or more matches and is used up; before it, nodes that hold the label's text or
    lie within it are listed too. Each match changes what is left, so a document is one group.
    """
    def of_document(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        side = lambda x: x if len(x) else pd.DataFrame(columns=["doc_id", "ordinal", "order_num", "page_num", "clean"])
        rows = _match(side(a), side(b), threshold)  # a side without rows comes without columns
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["doc_id", "label", "parsed", "score", "no"])

    # new aliases: where both sides come from one table, Spark would otherwise prune columns that the function reads
    clean = lambda df: df.select(*[F.col(c).alias(c) for c in ("doc_id", "ordinal", "order_num", "page_num")], F.coalesce(text.evaluation_text("text"), F.lit("")).alias("clean"))
    return clean(labels).groupBy("doc_id").cogroup(clean(parsed).groupBy("doc_id")).applyInPandas(of_document, "doc_id long, label string, parsed string, score double, no int")


def box_mapping(labels: DataFrame, parsed: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, label, parsed, kind): by boxes on the same page: the first match alone, with the small overlaps before it."""
    b = parsed.select("doc_id", "page_num", F.col("ordinal").alias("__o"), F.col("order_num").alias("parsed"), F.col("box").alias("__b"))
    met = labels.join(b, ["doc_id", "page_num"]).withColumn("kind", geometry.iou_class("box", "__b", share)).where("kind <> 'none'")
    first = F.min(F.when(F.col("kind") == "match", F.col("__o"))).over(Window.partitionBy("doc_id", "order_num"))
    kept = met.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("__o") <= F.col("__first")))
    return kept.select("doc_id", F.col("order_num").alias("label"), "parsed", "kind")


def confusion(mapped: DataFrame, labels: DataFrame, parsed: DataFrame) -> DataFrame:
    """(label_type, one column for each parsed type, p_0, p_N): weights of labels by what they were parsed as.

    One match: 1 to its type. Several: the share of equal types to the type of the last one, the rest to p_N. None: 1 to p_0.
    """
    of = lambda df, c, t: df.select("doc_id", F.col("order_num").alias(c), F.col("layout_type").alias(t))
    rows = mapped.join(of(labels, "label", "label_type"), ["doc_id", "label"]).join(of(parsed, "parsed", "parsed_type"), ["doc_id", "parsed"], "left")
    per = rows.groupBy("doc_id", "label", "label_type").agg(F.count("parsed").alias("n"), F.sum(F.when(F.col("parsed_type") == F.col("label_type"), 1.0).otherwise(0.0)).alias("hits"), F.max_by("parsed_type", "no").alias("last"))
    share = F.col("hits") / F.col("n")
    parts = F.when(F.col("n") == 0, F.array(F.struct(F.lit("p_0").alias("c"), F.lit(1.0).alias("w")))).when(F.col("n") == 1, F.array(F.struct(F.col("last").alias("c"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(F.col("last").alias("c"), share.alias("w")), F.struct(F.lit("p_N").alias("c"), (1 - share).alias("w"))))
    flat = per.select("label_type", F.explode(parts).alias("x")).select("label_type", "x.c", "x.w")
    return flat.groupBy("label_type").pivot("c", [*LABELS, "p_0", "p_N"]).agg(F.sum("w")).fillna(0.0)


def accuracies(matrix: DataFrame) -> DataFrame:
    """(label_type, right, total, accuracy) for each label type and, with a null type, over all; 0 for an empty row."""
    columns = [c for c in matrix.columns if c != "label_type"]
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    right = F.coalesce(*[F.when(F.col("label_type") == c, F.col(c)) for c in columns], F.lit(0.0))
    rows = matrix.select("label_type", right.alias("__r"), total.alias("__t"))
    out = rows.rollup("label_type").agg(F.sum("__r").alias("right"), F.sum("__t").alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("right") / F.col("total")).otherwise(F.lit(0.0)))


def block_scores(mapped: DataFrame) -> DataFrame:
    """(doc_id, score, matched, labels) for each document and, with a null id, over all: mean score with zeros for what isn't matched."""
    per = mapped.groupBy("doc_id", "label").agg(F.max("score").alias("s"))
    return per.rollup("doc_id").agg(F.avg("s").alias("score"), F.count_if(F.col("s") > 0).alias("matched"), F.count(F.lit(1)).alias("labels"))


def title_edges(nodes: DataFrame) -> DataFrame:
    """(doc_id, child, parent): each node under the last title before it; null without one."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("doc_id", F.col("order_num").alias("child"), F.last(F.when(F.col("layout_type") == "Title", F.col("order_num")), ignorenulls=True).over(w).alias("parent"))


def reverse_unique(mapped: DataFrame) -> DataFrame:
    """(doc_id, parsed, label): labels with exactly one match, turned round, where no other such label has it."""
    one = mapped.where(F.col("parsed").isNotNull()).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.first("parsed").alias("parsed")).where("n = 1")
    back = one.groupBy("doc_id", "parsed").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label")).where("n = 1")
    return back.select("doc_id", "parsed", "label")


def judged_edges(mapped: DataFrame, label_edges: DataFrame, parsed_edges: DataFrame) -> DataFrame:
    """(doc_id, child, parent, found): label edges under a parent; found if both ends have one match and the parser has the same edge."""
    one = mapped.where(F.col("parsed").isNotNull()).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.first("parsed").alias("parsed")).where("n = 1").drop("n")
    edges = label_edges.where(F.col("parent").isNotNull())
    child = one.select("doc_id", F.col("label").alias("child"), F.col("parsed").alias("__c"))
    parent = one.select("doc_id", F.col("label").alias("parent"), F.col("parsed").alias("__p"))
    held = parsed_edges.where(F.col("parent").isNotNull()).select("doc_id", F.col("child").alias("__c"), F.col("parent").alias("__p")).distinct().withColumn("__hit", F.lit(True))
    rows = edges.join(child, ["doc_id", "child"], "left").join(parent, ["doc_id", "parent"], "left").join(held, ["doc_id", "__c", "__p"], "left")
    return rows.select("doc_id", "child", "parent", F.coalesce("__hit", F.lit(False)).alias("found"))


def structure_accuracy(mapped: DataFrame, label_edges: DataFrame, parsed_edges: DataFrame) -> DataFrame:
    """(doc_id, right, total): label edges, and those that the parser has too (judged_edges)."""
    return judged_edges(mapped, label_edges, parsed_edges).groupBy("doc_id").agg(F.count_if("found").alias("right"), F.count(F.lit(1)).alias("total"))


def bad_cases(labels: DataFrame, mapped: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, kind, order_num, parent, text, parent_text): labels that no node matches (`split`), and label edges that weren't found (`edge`).

    mapped: (doc_id, label, parsed, score), a score of 0 where nothing matched; edges as from judged_edges.
    """
    own = labels.select("doc_id", "order_num", "text")
    matched = mapped.where(F.col("score") > 0).select("doc_id", F.col("label").alias("order_num")).distinct()
    split = own.join(matched, ["doc_id", "order_num"], "left_anti").select("doc_id", F.lit("split").alias("kind"), "order_num", F.lit(None).cast("string").alias("parent"), "text", F.lit(None).cast("string").alias("parent_text"))
    lost = edges.where(~F.col("found")).select("doc_id", F.col("child").alias("order_num"), "parent")
    above = own.select("doc_id", F.col("order_num").alias("parent"), F.col("text").alias("parent_text"))
    edge = lost.join(own, ["doc_id", "order_num"], "left").join(above, ["doc_id", "parent"], "left")
    return split.unionByName(edge.select("doc_id", F.lit("edge").alias("kind"), "order_num", "parent", "text", "parent_text"))


def report(cases: DataFrame) -> DataFrame:
    """(doc_id, n_split, n_edge, report): a document's bad cases as one text, a line each, by kind and then order number."""
    shown = F.when(F.col("kind") == "split", F.concat_ws(": ", F.concat_ws(" ", "kind", "order_num"), F.coalesce("text", F.lit("")))).otherwise(F.concat_ws(": ", F.concat_ws(" ", "kind", "order_num", F.lit("under"), "parent"), F.concat_ws(" | ", F.coalesce("parent_text", F.lit("")), F.coalesce("text", F.lit("")))))
    lines = F.array_sort(F.collect_list(F.struct("kind", "order_num", shown.alias("line"))))
    return cases.groupBy("doc_id").agg(F.count_if(F.col("kind") == "split").alias("n_split"), F.count_if(F.col("kind") == "edge").alias("n_edge"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


def filled_boxes(labels: DataFrame, mapped: DataFrame, parsed: DataFrame) -> DataFrame:
    """Labels with the box of their single match, and whether the texts differ."""
    one = mapped.where(F.col("parsed").isNotNull()).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.first("parsed").alias("__p")).where("n = 1")
    p = parsed.select("doc_id", F.col("order_num").alias("__p"), F.col("box").alias("matched_box"), F.col("text").alias("__t"))
    rows = labels.join(one.select("doc_id", F.col("label").alias("order_num"), "__p"), ["doc_id", "order_num"], "left").join(p, ["doc_id", "__p"], "left")
    return rows.withColumn("differs", F.col("__t").isNotNull() & (F.col("__t") != F.col("text"))).drop("__p", "__t")


def phrase_recall(phrases: DataFrame, recognised: DataFrame) -> DataFrame:
    """(file, found, phrases, recall) for each file and, with a null file, over all; a file without phrases has recall 1.

    phrases: (file, phrase) with a null phrase for a file without; recognised: (file, text). Compared on letters and digits.
    """
    rows = phrases.join(recognised, "file", "left").select("file", "phrase", F.when(F.contains(text.recognised_text(F.coalesce("text", F.lit(""))), text.recognised_text("phrase")), 1).otherwise(0).alias("hit"))
    out = rows.rollup("file").agg(F.sum(F.when(F.col("phrase").isNotNull(), F.col("hit")).otherwise(0)).alias("found"), F.count("phrase").alias("phrases"))
    return out.withColumn("recall", F.when(F.col("phrases") > 0, F.col("found") / F.col("phrases")).otherwise(F.lit(1.0)))
