"""Stream assembly and overlays (2.C): one ordered block stream for each book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.text import strip
from graphloom.scratch import discard, materialize

#: Block types that are passed over at page edges.
NOT_MERGEABLE = ["bibliographic", "note"]
LEAD_IN = r"(?i)^(?:in|for) (?:exercises?|problems?)\b|^(?:find|solve|compute|evaluate|determine|use)\b.*:$"
NUMBER = "[0-9]+"
LABEL = r"^(?:\*\*)?(?:Definition|Theorem|Lemma|Example|Exercise|Proof|Corollary|Proposition)\b"
STATES = r"\b(?:Definition|Theorem|Lemma|Corollary|Proposition|Exercise|Example)\b"
WORKS = r"\b(?:Proof|Solution|Example|Therefore|Hence)\b"
#: Order values that one block of a running sum spans.
SPAN = 4096


def numbered(number: str = NUMBER) -> str:
    """The pattern of a block that begins with a number (or what `number` matches)."""
    return rf"^\s*(?:{number})[.)]? "


def blocked_running_sum(rows: DataFrame, key: str, order: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """Adds the sum of `value` over rows of the key with a smaller order (an integer, unique within the key).

    Rows are cut into spans of order; sums of spans run over one row a span, and
    rows over their span only, so no key is ever sorted in one task.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order) / span))
    spans = cut.groupBy(key, "_span").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(key, "_span", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(offsets, [key, "_span"]).withColumn(out, F.col("_base") + F.col("_own")).drop("_span", "_base", "_own")


def flatten_stream(blocks: DataFrame) -> DataFrame:
    """Adds id: 0-based in (segment_index, pos) order within each book."""
    per_page = blocks.groupBy("source", "segment_index").agg(F.count("*").alias("n"))
    offsets = blocked_running_sum(per_page, "source", "segment_index", "n", "before").drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "segment_index").orderBy("pos")) - 1
    return blocks.withColumn("_rank", rank).join(offsets, ["source", "segment_index"]).withColumn("id", (F.col("before") + F.col("_rank")).cast("long")).drop("_rank", "before")


def mergeable_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("type").isin(NOT_MERGEABLE))


def _pages(blocks: DataFrame) -> DataFrame:
    """For each page: its first two and last two mergeable blocks."""
    rows = mergeable_blocks(blocks).select("source", "segment_index", "pos", "content")
    key, by = Window.partitionBy("source", "segment_index"), F.col("pos")
    ranked = rows.withColumn("up", F.row_number().over(key.orderBy(by))).withColumn("down", F.row_number().over(key.orderBy(by.desc())))
    one = lambda c, k: F.first(F.when(F.col(c) == k, F.struct("pos", "content")), ignorenulls=True)
    return ranked.where("up <= 2 or down <= 2").groupBy("source", "segment_index").agg(one("up", 1).alias("head"), one("up", 2).content.alias("second"), one("down", 1).alias("tail"), one("down", 2).content.alias("last_but_one"))


def _following(pages: DataFrame, span: int = 4096) -> DataFrame:
    """(source, top_index, bottom_index): each page and the next one of its book; spans of indices are linked apart and then joined."""
    cut = pages.select("source", "segment_index", F.floor(F.col("segment_index") / span).alias("s"))
    inner = cut.withColumn("next", F.lead("segment_index").over(Window.partitionBy("source", "s").orderBy("segment_index")))
    ends = cut.groupBy("source", "s").agg(F.min("segment_index").alias("first"), F.max("segment_index").alias("segment_index"))
    hops = ends.select("source", "segment_index", F.lead("first").over(Window.partitionBy("source").orderBy("s")).alias("hop"))
    return inner.join(hops, ["source", "segment_index"], "left").select("source", F.col("segment_index").alias("top_index"), F.coalesce("next", "hop").alias("bottom_index"))


def seam_pairs(pages: DataFrame, blocks: DataFrame, parity: int) -> DataFrame:
    """Adjacent pages whose upper index has this parity, both with a mergeable block: (source, top_index, bottom_index)."""
    has = mergeable_blocks(blocks).select("source", "segment_index").distinct()
    top = _following(pages)
    return (
        top.where((F.col("top_index") % 2 == parity) & F.col("bottom_index").isNotNull())
        .join(has.withColumnRenamed("segment_index", "top_index"), ["source", "top_index"], "left_semi")
        .join(has.withColumnRenamed("segment_index", "bottom_index"), ["source", "bottom_index"], "left_semi")
        .select("source", "top_index", "bottom_index")
    )


def seam_edges(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tail and head of each pair with the block before and after as context."""
    edges = _pages(blocks)
    top = edges.select("source", F.col("segment_index").alias("top_index"), "tail", F.col("last_but_one").alias("context_before"))
    bottom = edges.select("source", F.col("segment_index").alias("bottom_index"), "head", F.col("second").alias("context_after"))
    joined = pairs.join(top, ["source", "top_index"]).join(bottom, ["source", "bottom_index"])
    return joined.select("source", "top_index", "bottom_index", F.col("tail.pos").alias("tail_pos"), F.col("tail.content").alias("tail"), F.col("head.pos").alias("head_pos"), F.col("head.content").alias("head"), "context_before", "context_after")


def judge_seam(tail: Column, head: Column) -> Column:
    """One interrupted block: the tail lacks closing punctuation and the head starts in lower case."""
    return ~strip(tail).rlike(r"[.!?:;]$") & strip(head).rlike(r"^\p{Ll}")


def join_halves(tail: Column, head: Column) -> Column:
    """A hyphen at the break goes; otherwise one space is put in; a doubled pair of dollars or fences goes."""
    a, b = F.regexp_replace(tail, r"\s+$", ""), F.regexp_replace(head, r"^\s+", "")
    glued = F.when(a.rlike(r"\p{L}-$"), F.concat(F.regexp_replace(a, "-$", ""), b))
    for mark in (r"\$\$", r"\$", "```"):
        glued = glued.when(a.rlike(f"{mark}$") & b.rlike(f"^{mark}"), F.concat(F.regexp_replace(a, f"{mark}$", ""), F.lit(" "), F.regexp_replace(b, f"^{mark}", "")))
    return glued.otherwise(F.concat(a, F.lit(" "), b))


def seam_decisions(edges: DataFrame) -> DataFrame:
    """The default rule as a decision table: (source, top_index, is_split, merged)."""
    return edges.select("source", "top_index", judge_seam(F.col("tail"), F.col("head")).alias("is_split"), join_halves(F.col("tail"), F.col("head")).alias("merged"))


def _heal(pages: DataFrame, blocks: DataFrame, parity: int, decide) -> DataFrame:
    edges = seam_edges(seam_pairs(pages, blocks, parity), blocks)
    agreed = edges.join(decide(edges).where("is_split").select("source", "top_index", "merged"), ["source", "top_index"])
    tails = agreed.select("source", F.col("top_index").alias("segment_index"), F.col("tail_pos").alias("pos"), "merged")
    heads = agreed.select("source", F.col("bottom_index").alias("segment_index"), F.col("head_pos").alias("pos"))
    out = blocks.join(tails, ["source", "segment_index", "pos"], "left").withColumn("content", F.coalesce("merged", "content")).drop("merged")
    return out.join(heads, ["source", "segment_index", "pos"], "left_anti")


def heal_seams(blocks: DataFrame, decide=seam_decisions) -> DataFrame:
    """Even seams, then odd seams on what the first pass left. `decide` turns edges into (source, top_index, is_split, merged)."""
    blocks = materialize(blocks, "blocks")
    pages = materialize(blocks.select("source", "segment_index").distinct(), "pages")
    for parity in (0, 1):
        healed = materialize(_heal(pages, blocks, parity, decide), "healed")
        discard(blocks)
        blocks = healed
    discard(pages)
    return blocks


def packed_pieces(nodes: DataFrame, number: str = NUMBER) -> DataFrame:
    """(source, id, piece, number, body) of blocks that pack two numbered items or more; a leading fragment has no number."""
    mark = numbered(number)
    pieces = F.filter(F.split("content", rf"\n(?=\s*(?:{number})[.)]? )"), lambda x: strip(x) != "")
    many = F.size(F.filter(pieces, lambda x: x.rlike(mark)))
    rows = nodes.where(many >= 2).select("source", "id", F.posexplode(pieces).alias("piece", "text"))
    found = F.regexp_extract("text", rf"^\s*({number})[.)]? ", 1)
    return rows.select("source", "id", "piece", F.when(found != "", found).alias("number"), strip(F.regexp_replace("text", mark, "")).alias("body"))


def rebuild_stream(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Split rows replaced by their pieces, with type and page of the original, and new ids."""
    text = F.when(F.col("number").isNotNull(), F.concat("number", F.lit(" "), "body")).otherwise(F.col("body"))
    split = pieces.select("source", "id", "piece", text.alias("content")).join(nodes.drop("content"), ["source", "id"])
    whole = nodes.join(pieces.select("source", "id").distinct(), ["source", "id"], "left_anti").withColumn("piece", F.lit(0))
    every = split.select(*whole.columns).unionByName(whole)
    per_node = every.groupBy("source", "id").agg(F.count("*").alias("n"))
    offsets = blocked_running_sum(per_node, "source", "id", "n", "before").drop("n")
    return every.join(offsets, ["source", "id"]).withColumn("id", (F.col("before") + F.col("piece")).cast("long")).drop("before", "piece")


def tag_lead_ins(nodes: DataFrame, lead_in: str = LEAD_IN, number: str = NUMBER) -> DataFrame:
    lead = F.col("content").rlike(lead_in) & ~F.col("content").rlike(numbered(number))
    return nodes.withColumn("type", F.when(lead, F.lit("instruction")).otherwise(F.col("type")))


def clamp(position: Column, size: Column) -> Column:
    """A position moved into 0 .. size - 1."""
    return F.least(F.greatest(position, F.lit(0)), size - 1)


def lead_in_candidates(nodes: DataFrame) -> DataFrame:
    """(source, lead_in_id, id, position, content) of the blocks after each lead-in, up to the next one of the book."""
    flagged = nodes.withColumn("_lead", (F.col("type") == "instruction").cast("int"))
    summed = blocked_running_sum(flagged, "source", "id", "_lead", "_group")
    grouped = summed.withColumn("_group", F.col("_group") + F.col("_lead")).where("_group > 0")
    leads = grouped.where("_lead = 1").select("source", "_group", F.col("id").alias("lead_in_id"))
    rest = grouped.where("_lead = 0").join(leads, ["source", "_group"])
    return rest.select("source", "lead_in_id", "id", (F.col("id") - F.col("lead_in_id") - 1).cast("int").alias("position"), "content")


def governed_run(candidates: DataFrame, number: str = NUMBER) -> DataFrame:
    """Default decision: the leading run of numbered blocks. (source, lead_in_id, governed_positions sorted, without repeats)."""
    stop = F.min(F.when(~F.col("content").rlike(numbered(number)), F.col("position")))
    runs = candidates.groupBy("source", "lead_in_id").agg(F.coalesce(stop, F.max("position") + 1).alias("n"))
    return runs.where("n > 0").select("source", "lead_in_id", F.sequence(F.lit(0), F.col("n") - 1).alias("governed_positions"))


def instruction_hubs(nodes: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(source, node_id, text, directive, members); positions are clamped, sorted and distinct; none gives no hub."""
    sizes = candidates.groupBy("source", "lead_in_id").agg(F.count("*").cast("int").alias("n"))
    places = decisions.join(sizes, ["source", "lead_in_id"]).select("source", "lead_in_id", F.explode(F.array_distinct(F.transform("governed_positions", lambda p: clamp(p, F.col("n"))))).alias("position"))
    members = places.join(candidates, ["source", "lead_in_id", "position"]).groupBy("source", "lead_in_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    text = nodes.select("source", F.col("id").alias("lead_in_id"), F.col("content").alias("text"))
    directive = strip(F.regexp_replace("text", r"(?i)^(?:in|for) (?:exercises?|problems?)[^,:]*[,:]", ""))
    return members.join(text, ["source", "lead_in_id"]).select("source", F.col("lead_in_id").alias("node_id"), "text", F.when(directive != "", directive).alias("directive"), "members")


def drop_lead_ins(nodes: DataFrame) -> DataFrame:
    return nodes.where("type <> 'instruction'")


def normalize_spans(spans: DataFrame) -> DataFrame:
    """Start and end clamped into the window, the end not before the start; overlaps stay."""
    start = clamp(F.col("start"), F.col("size"))
    return spans.where("size > 0").withColumn("start", start).withColumn("end", F.greatest(clamp(F.col("end"), F.col("size")), F.col("start")))


def find_units(nodes: DataFrame, label: str = LABEL) -> DataFrame:
    """Default decision: a labelled block up to the next label or heading. (source, span_id, start, end, n); members are `span_members`."""
    labelled = F.col("content").rlike(label)
    flagged = nodes.select("source", "id", (labelled | (F.col("type") == "header")).cast("int").alias("_cut"), labelled.alias("_label"))
    summed = blocked_running_sum(flagged, "source", "id", "_cut", "_unit").withColumn("_unit", F.col("_unit") + F.col("_cut"))
    units = summed.groupBy("source", "_unit").agg(F.min("id").alias("start"), F.max("id").alias("end"), F.min_by("_label", "id").alias("_label"), F.count("*").alias("n"))
    return units.where("_label").select("source", F.col("start").alias("span_id"), "start", "end", "n")


def span_members(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, span_id, id): the nodes of each span, one row each, as a span has any size; spans may overlap."""
    cells = F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))
    cut = spans.select("source", "span_id", "start", "end", F.explode(cells).alias("_cell"))
    met = cut.join(nodes.select("source", "id", F.floor(F.col("id") / SPAN).alias("_cell")), ["source", "_cell"])
    return met.where("id between start and end").select("source", "span_id", "id")


def span_contents(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, span_id, id, content): member texts that are not blank, in order of id."""
    return members.join(nodes.select("source", "id", "content"), ["source", "id"]).where(strip(F.col("content")) != "").select("source", "span_id", "id", "content")


def type_roles(contents: DataFrame, states: str = STATES, works: str = WORKS) -> DataFrame:
    """Default decision: whether a span states something, and whether it works something out, from its members' texts."""
    said = lambda pattern: F.bool_or(F.col("content").rlike(pattern))
    return contents.groupBy("source", "span_id").agg(said(states).alias("has_statement"), said(works).alias("has_procedure"))


def roleless(roles: DataFrame) -> DataFrame:
    """Spans with neither role: each is an error."""
    return roles.where("not has_statement and not has_procedure")


def require_roles(roles: DataFrame) -> DataFrame:
    fine = F.col("has_statement") | F.col("has_procedure")
    return roles.withColumn("has_statement", F.when(fine, F.col("has_statement")).otherwise(F.raise_error(F.lit("a span has no role"))))


def select_members(members: DataFrame, positions: DataFrame) -> DataFrame:
    """Members (source, span_id, id) at the chosen 0-based positions (source, span_id, position) of their span; those out of range drop, a span with nothing selected keeps all."""
    keyed = members.withColumn("_key", F.concat("source", F.lit("#"), F.col("span_id").cast("string"))).withColumn("_one", F.lit(1))
    placed = materialize(blocked_running_sum(keyed, "_key", "id", "_one", "position").select("source", "span_id", "id", "position"), "placed-members")
    chosen = placed.join(positions.select("source", "span_id", "position").distinct(), ["source", "span_id", "position"], "left_semi").select("source", "span_id", "id")
    whole = placed.join(chosen.select("source", "span_id").distinct(), ["source", "span_id"], "left_anti").select("source", "span_id", "id")
    return chosen.unionByName(whole)


def build_hubs(spans: DataFrame, roles: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, procedures) of spans whose first node exists: (source, span_id, start, end), procedures with their index. All members of a span are its block."""
    first = nodes.select("source", F.col("id").alias("start"))
    known = spans.join(first, ["source", "start"], "left_semi").join(roles, ["source", "span_id"])
    columns = ["source", "span_id", "start", "end"]
    return known.where("has_statement").select(*columns), known.where("has_procedure").select(*columns, F.lit(0).alias("index"))


def both_blocks(statements: DataFrame, procedures: DataFrame) -> DataFrame:
    """Blocks (source, start, end) that are statement and procedure."""
    at = ["source", "start", "end"]
    return statements.select(*at).join(procedures.select(*at), at, "left_semi").distinct()
