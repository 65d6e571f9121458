"""Facts, triplets, descriptions and embeddings (2.E)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.stream import blocked_running_sum
from graphloom.operators.text import strip

#: Block types that yield no facts.
NO_FACTS = ["header", "bibliographic", "caption"]
#: Words of the default clause rule: verbs, conjunctions before a verb, openings of conditions and of reasons, and what a verb takes along.
VERBS = ["is", "are", "was", "were", "has", "have", "had", "contains", "implies", "equals", "denotes", "ist", "sind", "war", "hat", "est", "sont", "es", "son", "tiene"]
JOINS, IFS, REASONS = "and|or|und|oder|et|ou|y|o", "if|iff|when|whenever|wenn|falls|si|cuando", "because|since|weil|parce que|porque"
VERB = "|".join(VERBS)
#: A negation, a naming or comparing word, `a ... of`, or a word with a preposition belongs to the predicate.
PHRASE = rf"^((?:{VERB})(?: (?:not|NOT|nicht|pas|no))?(?: (?:called|known as|defined as|equal to)| (?:a|an|the) [a-z]+ of| [a-z]+ (?:at|on|by|to|from|in|as|with))?) (.+)$"
#: `has` with a noun before a formula.
MEASURE = r"^((?:has|have|had) [a-z]+) (\$.+)$"
FRAME, SO = "^(?:Prove|Show|Verify|Check) that ", ",? (?:and )?if so(?:,| |$).*$"
REQUEST = "(?i)^(?:if|when|given|assuming|what|which|how|find|compute|determine|evaluate)(?: |,|$)"
ASKED = r"^(Is|Are|Was|Were) (.+) ([^ ]+)$"
#: Subjects that name nothing by themselves.
EMPTY = "(?i)^(?:there|it|this|that|such|these|those|he|she|they|we)(?: .*)?$|^(?i:the resulting) .*$"
#: A noun with its symbol goes by the symbol; an equation is a relation.
SYMBOL, EQUATION = r"^(?:A|An|The|a|an|the) [a-z]+ (\$[^$]+\$)$", r"^\$([^$=]+?) = ([^$=]+)\$$"
DIMENSIONS = 64


def extract_facts(nodes: DataFrame) -> DataFrame:
    """Default decision: one row for each sentence. (source, id, pos, text, node_ids)."""
    rows = nodes.where(~F.col("type").isin(NO_FACTS)).select("source", "id", F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("pos", "text"))
    return rows.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("node_ids", F.array("id"))


def index_facts(facts: DataFrame) -> DataFrame:
    """Adds `index`: 0-based in order of the document."""
    per_node = facts.groupBy("source", "id").agg(F.count("*").alias("n"))
    offsets = blocked_running_sum(per_node, "source", "id", "n", "before").drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "id").orderBy("pos")) - 1
    return facts.withColumn("_rank", rank).join(offsets, ["source", "id"]).withColumn("index", (F.col("before") + F.col("_rank")).cast("long")).drop("before", "_rank")


def dedup_facts(facts: DataFrame, window: str = "window_id") -> DataFrame:
    """The first of equal claims of a window."""
    return facts.groupBy("source", window, "text").agg(F.min("index").alias("index"))


def _triplet(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), object_.alias("object"))


def _relation(subject: Column, phrase: Column) -> Column:
    """The triplet of a subject and what is said of it; parts that are missing are empty."""
    measured = phrase.rlike(MEASURE)
    part = lambda k: F.when(measured, F.regexp_extract(phrase, MEASURE, k)).otherwise(F.regexp_extract(phrase, PHRASE, k))
    named = F.regexp_extract(subject, SYMBOL, 1)
    clean = lambda c: F.regexp_replace(c, "^[ ,;:]+|[ ,;:]+$", "")
    return _triplet(clean(F.when(named != "", named).otherwise(subject)), part(1), clean(part(2)))


def _clauses(part: Column) -> Column:
    """The triplets of a sentence or a condition: the first verb ends the subject; verbs after a conjunction share it."""
    opening = rf"^(.+?) (?:{VERB}) "
    subject = F.regexp_extract(part, opening, 1)
    rest = F.substr(part, F.length(subject) + 2)
    phrases = F.split(F.regexp_replace(rest, rf",? (?:{JOINS}) ({VERB}) ", "\u0001$1 "), "\u0001")
    equation = F.array(_triplet(F.regexp_extract(part, EQUATION, 1), F.lit("equals"), F.regexp_extract(part, EQUATION, 2)))
    return F.when(part.rlike(EQUATION), equation).when(subject != "", F.transform(phrases, lambda p: _relation(subject, p))).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))


def fact_triplets(text: Column) -> Column:
    """array of struct(subject, predicate, object): the relations of a fact; subjects and objects are substrings of it.

    A parser of clauses: end marks, a frame (`Prove that`) and a follow-up question
    go, reasons go with their conjunction. A question (`Is X Y?`) states its
    relation. A request for a value, a clause about a property and a subject that
    names nothing (`there`, `it`, `such ...`) have none. Conditions are clauses of
    their own; verbs joined by a conjunction share their subject; a negation and a
    preposition stay with the verb.
    """
    bare = F.regexp_replace(text, "[.!?]+$", "")
    framed = F.regexp_replace(bare, FRAME, "")
    told = F.regexp_replace(F.regexp_replace(framed, SO, ""), rf",? (?:{REASONS}) .*$", "")
    asked = F.array(_triplet(F.regexp_extract(told, ASKED, 2), F.lower(F.regexp_extract(told, ASKED, 1)), F.regexp_extract(told, ASKED, 3)))
    parts = F.split(F.regexp_replace(told, rf",? (?:{IFS}) ", "\u0001"), "\u0001")
    stated = F.flatten(F.transform(parts, _clauses))
    none = told.rlike(REQUEST) | F.contains(told, F.lit("property that"))
    found = F.when(none, F.array().cast("array<struct<subject:string,predicate:string,object:string>>")).when(F.endswith(text, F.lit("?")) & told.rlike(ASKED), asked).otherwise(stated)
    return F.array_distinct(F.filter(found, lambda t: (t.subject != "") & (t.predicate != "") & (t.object != "") & ~t.subject.rlike(EMPTY)))


def extract_triplets(facts: DataFrame) -> DataFrame:
    """Default decision: (source, fact_index, subject, predicate, object), several for a fact, by its clauses (`fact_triplets`)."""
    rows = facts.select("source", F.col("index").alias("fact_index"), F.explode(fact_triplets(F.col("text"))).alias("t"))
    return rows.select("source", "fact_index", "t.subject", "t.predicate", "t.object")


def not_verbatim(triplets: DataFrame, facts: DataFrame) -> DataFrame:
    """Triplets whose subject or object is no substring of its fact."""
    joined = triplets.join(facts.select("source", F.col("index").alias("fact_index"), "text"), ["source", "fact_index"])
    return joined.where(~F.contains("text", "subject") | ~F.contains("text", "object")).drop("text")


def dedup_triplets(triplets: DataFrame) -> DataFrame:
    return triplets.dropDuplicates(["source", "fact_index", "subject", "predicate", "object"])


def node_fact_index(facts: DataFrame) -> DataFrame:
    return facts.select("source", F.explode("node_ids").alias("node_id"), F.col("index").alias("fact_index"))


def node_triplets(triplets: DataFrame, facts: DataFrame) -> DataFrame:
    return node_fact_index(facts).join(triplets, ["source", "fact_index"])


def _line(sep: str = " | ") -> Column:
    return F.concat_ws(sep, "subject", "predicate", "object")


def local_entities(by_node: DataFrame) -> DataFrame:
    """(source, node_id, name, triplets): distinct endpoints of each node with the triplets that hold them."""
    ends = by_node.select("source", "node_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("name"), _line().alias("line"))
    return ends.groupBy("source", "node_id", "name").agg(F.array_sort(F.collect_set("line")).alias("triplets"))


def local_relations(by_node: DataFrame) -> DataFrame:
    return by_node.groupBy("source", "node_id", "predicate").agg(F.array_sort(F.collect_set(_line())).alias("triplets"))


def describe(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Default decision: a name is described by its triplets; nodes with blank text are skipped."""
    told = nodes.where(strip(F.col("content")) != "").select("source", F.col("id").alias("node_id"))
    return names.join(told, ["source", "node_id"], "left_semi").withColumn("description", F.array_join("triplets", "; "))


def description_at(wanted: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Adds the first description (by pos) of each (source, node_id, name), else null."""
    first = descriptions.groupBy("source", "node_id", "name").agg(F.min_by("description", "pos").alias("description"))
    return wanted.join(first, ["source", "node_id", "name"], "left")


def embed_text(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), description))


def hashed_vector(text: str, dim: int = DIMENSIONS) -> np.ndarray:
    """The default provider: signed counts of hashed tokens, scaled to length 1."""
    import zlib

    v = np.zeros(dim)
    for token in text.lower().split():
        h = zlib.crc32(token.encode())
        v[h % dim] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def attach_embeddings(rows: DataFrame, text: str = "text", provider=None, dim: int = DIMENSIONS) -> DataFrame:
    """Adds `embedding` of the text; each distinct text is embedded once. `provider` maps a list of texts to vectors."""
    embed = provider or (lambda texts: [hashed_vector(t, dim) for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                yield pd.DataFrame({text: part[text], "embedding": [np.asarray(v, float).tolist() for v in embed(part[text].tolist())]})

    vectors = rows.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, embedding array<double>")
    return rows.join(vectors, text, "left")


def embedding_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, t in tables.items():
        one = t.agg(F.count_if(F.col("embedding").isNotNull()).alias("with_vector"), F.count_if(F.col("embedding").isNull()).alias("without_vector")).select(F.lit(label).alias("label"), "*")
        out = one if out is None else out.unionByName(one)
    return out
