"""Chat formatting of reply trees, in DataFrame functions only.

Paths are found by iterative self-joins by pointer doubling. Every message holds
one ancestor, its distance and the sum of the scores between, as three numbers;
joining it with that ancestor doubles the reach, so the rounds are the logarithm
of the deepest reply. Leaves are ranked by the sum of their path's scores (ties:
the deeper, then the smaller leaf id). Only for the best ``keep`` of each tree are
the paths' messages listed, by the same pointers from the longest to the shortest:
each message of a path comes up once. So nothing is larger than the messages, or
than the paths that are formatted. Texts join last.

Format: each turn is ``### role: text</turn>`` and a line end. Inside a role or
text a backslash becomes ``\\b``, ``###`` becomes ``\\h`` and ``</turn>`` becomes
``\\e`` (in a role also ``:`` ``\\c``), so the controls never occur there and the
texts come back exactly.

Null text or role counts as empty, null score as 0. A message whose parent is
null or missing is a root. Messages whose ancestry runs in a circle have no root
and so no path. Of messages that repeat an id in a tree, one stands: that of the
least parent, then score, then hash of role and text. Rows without tree_id or
msg_id belong to no tree and are left out; in op1_chat_format, rows without
conv_id are one conversation. Columns with other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

HEAD, END = "### ", "</turn>\n"
#: (control, escape), in the order of escaping.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for control, code in pairs:
        c = F.replace(c, F.lit(control), F.lit(code))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for control, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(control))
    return c


def mark() -> Column:
    """Tells a message's row from others of its id."""
    return F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("mark")


def one_of_each(messages: DataFrame, unique: bool = False) -> DataFrame:
    """(tree_id, msg_id, parent_id, score, mark): messages without texts, one for each id."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    own = F.struct("parent_id", score, mark())
    there = messages.where("tree_id is not null and msg_id is not null")
    if unique:
        return there.select("tree_id", "msg_id", "parent_id", score, mark())
    return there.groupBy("tree_id", "msg_id").agg(F.min(own).alias("own")).select("tree_id", "msg_id", "own.*")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree_id, msg_id, up) by 1, 2, 4, ... replies, and (tree_id, msg_id, depth, total) of messages with a root."""
    ids = nodes.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"))
    first = nodes.join(ids, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_m")), "left")
    first = first.select("tree_id", "msg_id", F.col("_m").alias("up"), F.when(F.col("_m").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total"))
    state, jumps, was = checkpointed(first), [], None
    while True:
        left = state.where("up is not null")
        now = left.count()
        if now in (0, was):  # each length of path up to the longest ends somewhere, so a round that ends none leaves circles only
            return jumps, state.where("up is null").drop("up")
        was = now
        jumps.append(left.select("tree_id", "msg_id", "up"))
        above = state.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        step = left.join(above, (F.col("tree_id") == F.col("_t")) & (F.col("up") == F.col("_m")))
        step = step.select("tree_id", "msg_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        state = checkpointed(state.where("up is null").unionByName(step))


def best_paths(messages: DataFrame, keep: int = 1, unique: bool = False) -> DataFrame:
    """(tree_id, leaf_id, at, msg_id, mark): the messages of each tree's best paths, at from 0 at the root."""
    nodes = checkpointed(one_of_each(messages, unique))
    jumps, reached = climb(nodes)
    parents = nodes.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_m")).where("_m is not null").distinct()
    leaves = reached.join(parents, (F.col("tree_id") == F.col("_t")) & (F.col("msg_id") == F.col("_m")), "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "msg_id")
    kept = leaves.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
    paths = checkpointed(kept.select("tree_id", F.col("msg_id").alias("leaf_id"), F.col("depth").alias("at"), "msg_id"))
    for k in reversed(range(len(jumps))):  # every distance is one sum of powers of two
        jump = jumps[k].select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), "up")
        higher = paths.join(jump, (F.col("tree_id") == F.col("_t")) & (F.col("msg_id") == F.col("_m")))
        paths = checkpointed(paths.unionByName(higher.select("tree_id", "leaf_id", (F.col("at") - (1 << k)).alias("at"), F.col("up").alias("msg_id"))))
    marks = nodes.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), "mark")
    return paths.join(marks, (F.col("tree_id") == F.col("_t")) & (F.col("msg_id") == F.col("_m"))).drop("_t", "_m")


def format_paths(paths: DataFrame, messages: DataFrame, unique: bool = False) -> DataFrame:
    """(tree_id, leaf_id, formatted, loss) of paths (tree_id, leaf_id, at, msg_id, mark).

    loss has an entry for each turn: an assistant's text's start and length in code points, from 0, and its turn's start; null for others.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    said = messages.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), mark().alias("_mark"), role, text)
    if not unique:
        said = said.dropDuplicates(["_t", "_m", "_mark"])
    met = paths.join(said, (F.col("tree_id") == F.col("_t")) & (F.col("msg_id") == F.col("_m")) & (F.col("mark") == F.col("_mark")))
    head, body = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(": ")), escape(F.col("text"))
    cut = met.select("tree_id", "leaf_id", "at", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn"))
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)))
    got = cut.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "learn", "start"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    span = lambda t: F.struct((t["start"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"), t["start"].alias("turn_start"))
    return got.select("tree_id", "leaf_id", whole.alias("formatted"), F.transform("turns", lambda t: F.when(t["learn"], span(t))).alias("loss"))


def format_trees(messages: DataFrame, keep: int = 1, unique: bool = False) -> DataFrame:
    """Format the best ``keep`` root-to-leaf paths of each tree of (tree_id, msg_id, parent_id, role, text, score).

    unique: no id repeats in a tree, which spares the search for repeats.
    """
    return format_paths(best_paths(messages, keep, unique), messages, unique)


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (role, text) and learned, the unescaped text under the loss mask, both from the formatted string alone."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)

    def turn(p: Column) -> Column:
        colon = F.instr(p, ": ")
        role = unescape(p.substr(F.lit(len(HEAD) + 1), colon - len(HEAD) - 1), ROLE_ESCAPES)
        return F.struct(role.alias("role"), unescape(p.substr(colon + 2, F.length(p))).alias("text"))

    # each span is cut from its own turn, so long conversations are not read from the start for every turn
    said = F.zip_with(pieces, "loss", lambda p, s: F.when(s.isNotNull(), unescape(p.substr((s["start"] - s["turn_start"] + 1).cast("int"), s["length"]))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "learned": F.array_join(said, "")})


def chains(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees without branches: each row answers the one before it by turn (ties: role, then text).

    tree_id is conv_id as a string, of one zero byte where it is null.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = rows.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(w))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("tree_id")
    return n.select(tree, "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_trees(chains(rows.unionByName(probe)), unique=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree_id").try_cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 2
           + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) + 8)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
