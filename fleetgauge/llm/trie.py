"""Prefix tries of conversations: what shared openings save, node by node.

A conversation is the row of its turns' ids, a node a distinct sequence of first turns.

1. A turn's id is the first 16 bytes of a SHA-256 of its role and text. Texts are read
   once, where they lie; only ids and word counts are shuffled.
2. Conversations are sorted by their first ``LEAD`` turns, then by number, and cut into
   range shards of about ``SHARD`` turns, however large the input is. Equal conversations
   may lie in several shards, so a common one is no hot key.
3. A shard pads its ids to a matrix, ``LEAD`` columns at a time, and sorts the rows by
   all columns. A mask of changes from row to row, accumulated by OR from column to
   column, marks where nodes start at each depth; ``reduceat`` folds their members.
   Rows that go on past the last column go on to the next matrix, so one long
   conversation does not widen the others.
4. Only nodes on the way to a shard's first or last row can have members elsewhere.
   Their parts are folded by a hash of their path. What lies below them is summed by
   doubling: in round k a node passes what it has to its ancestor 2**k levels up.
5. Digests of a boundary node's ends are made from sorted runs of ids, in order, by one
   task with bounded memory; a running hash cannot be split.

A null role or text is empty. Turns go by ``turn``, null first; rows of one turn go by
the ids of their turns, and repeated rows are turns each. Rows without a conversation
number belong to none. Empty texts are turns of no words. Without conversations there is
no root, so no row. Columns besides the four named ones are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import arrow_schema, column
from fleetgauge.session import stored

#: Turns by which conversations are cut into shards, and columns of a matrix.
LEAD = 64

#: Turns in a shard, on average.
SHARD = 1 << 20

#: Numbers in one run of a node's ends.
RUN = 8192

#: Conversations that share the opening of the first of them, and the longest opening.
FAMILY, OPENING = 20, 4

#: What separates words; fixed value.
WORD = r"[^\x20\x09-\x0D]+"

NODE = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
    "saved_tokens", "ends_sha256",
]

_PART = (
    "kind string, shard bigint, key binary, parent_key binary, conv_id bigint, depth bigint,"
    " parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, words bigint, ends_sha256 string, run string"
)


def conversations_of(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id`` and its ``turns``, as structs of ``id`` and ``words``, in order."""
    said = F.coalesce(column(text), F.lit(""))
    who = F.coalesce(column(role), F.lit(""))
    named = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    digest = F.substring(F.unhex(F.sha2(named, 256)), 1, 16)
    return (
        turns.filter(column(conv_id).isNotNull())
        .select(
            column(conv_id).cast("bigint").alias("conv_id"),
            F.struct(
                column(turn).cast("bigint").alias("turn"), digest.alias("id"),
                F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("words"),
            ).alias("row"),
        )
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select(
            "conv_id",
            F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["words"].alias("words")))
            .alias("turns"),
        )
    )


def with_family_opening(
    conversations: DataFrame, family: int = FAMILY, opening: int = OPENING
) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its family.

    How many are taken goes by the conversation's own number. Where the family's first
    is missing or shorter, fewer turns are put in; the own ones go all the same.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % opening
    own = conversations.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("first"),
        taken.cast("int").alias("taken"), "turns",
    )
    firsts = conversations.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, opening - 1).alias("opening")
    )
    left = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    put = F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    return own.join(firsts, "first", "left").select(
        "conv_id",
        F.concat(put, F.when(F.col("taken") < F.size("turns"), left)
                 .otherwise(F.slice("turns", 1, 0))).alias("turns"),
    )


def _columns(words: np.ndarray, offsets: np.ndarray, rows: np.ndarray, start: int, width: int):
    """Columns ``start`` to ``start + width`` of the padded matrix of some rows."""
    at = offsets[rows, None] + start + np.arange(width)
    inside = at < offsets[rows + 1, None]
    return np.where(inside[:, :, None], words[np.minimum(at, len(words) - 1)], 0), inside


def _digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest()


NO_ENDS = hashlib.sha256(b"").hexdigest()


class Shard:
    """The nodes of one shard's conversations."""

    def __init__(self, conv: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.conv, self.offsets, self.counts = conv, offsets, counts
        self.length = np.diff(offsets)
        self.ids = ids  # two big-endian halves of each turn's id
        #: Of each depth: start of each node in ``order``, its parent in the depth above,
        #: members, least member, words of the last turn, ends, whether it is on a boundary.
        self.levels: list[dict[str, np.ndarray]] = []
        self.build()

    def build(self) -> None:
        rows = np.arange(len(self.conv))
        group = np.zeros(len(rows), np.int64)
        start = 0
        while True:
            width = int(min(LEAD, max(0, self.length[rows].max(initial=0) - start)))
            matrix, inside = _columns(self.ids, self.offsets, rows, start, width)
            keys = [self.conv[rows]]
            for j in reversed(range(width)):
                keys += [matrix[:, j, 1], matrix[:, j, 0]]
            order = np.lexsort([*keys, group])
            rows, group, matrix, inside = rows[order], group[order], matrix[order], inside[order]
            change = np.zeros((len(rows), width + 1), bool)
            change[0, 0] = True
            change[1:, 0] = group[1:] != group[:-1]
            change[1:, 1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
            change[1:, 1:] |= inside[1:] != inside[:-1]  # an end before a turn whose id is zero
            change = np.logical_or.accumulate(change, axis=1)
            if not start:
                self.level(rows, change[:, 0], np.ones(len(rows), bool), None)
            for j in range(width):
                above = group if start and not j else np.cumsum(change[:, j]) - 1
                if j:  # numbers of the nodes above, without the segments of ended rows
                    heads = np.flatnonzero(change[:, j])
                    valid = inside[heads, j - 1]
                    above = (np.cumsum(valid) - 1)[above]
                group_next = self.level(rows, change[:, j + 1], inside[:, j], above, start + j)
            if width < LEAD:
                return
            on = inside[:, -1]
            rows, group = rows[on], group_next[on]
            start += LEAD
            if not len(rows):
                return

    def level(
        self, rows: np.ndarray, starts: np.ndarray, inside: np.ndarray,
        above: np.ndarray | None, at: int = -1,
    ) -> np.ndarray:
        """Add the nodes of one depth; the number of each row's node."""
        heads = np.flatnonzero(starts)
        nodes = inside[heads]
        conv, ended = self.conv[rows], self.length[rows] == at + 1
        first = heads[nodes]
        size = np.diff(np.append(heads, len(rows)))[nodes]
        n_ends = np.add.reduceat(ended.astype(np.int64), heads)[nodes]
        least = np.minimum.reduceat(conv, heads)[nodes]
        number = (np.cumsum(nodes) - 1)[np.cumsum(starts) - 1]
        if above is None:
            parent, words, edge = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)
        else:
            parent = above[first]
            words = self.counts[self.offsets[rows[first]] + at]
            edge = self.levels[-1]["edge"][parent]
            if at < LEAD:  # the first and the last row of the shard's order
                edge = edge & ((first == 0) | (first + size == len(rows)))
        # At the last column ends lie among rows that go on, still by number.
        at_end = np.flatnonzero(ended)
        of_ends = np.searchsorted(at_end, first)
        ends = [
            conv[at_end[s : s + n]]
            for s, n in zip(of_ends.tolist(), n_ends.tolist(), strict=True)
        ]
        self.levels.append({
            "row": rows[first], "parent": parent, "n_convs": size, "conv_id": least,
            "words": words, "edge": edge, "ends": ends,
        })
        return number

    def records(self) -> Iterator[dict]:
        """Whole nodes, parts of boundary nodes, and runs of the latter's ends."""
        below = None
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            n = len(level["n_convs"])
            children, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
            if below is not None:
                under, totals = below
                own = ~under["edge"]  # boundary children come in when shards meet
                at = under["parent"][own]
                np.add.at(children, at, 1)
                np.add.at(leaves, at, totals[1][own])
                np.add.at(saved, at, totals[2][own])
            whole = ~level["edge"]
            leaves[whole & (children == 0)] = 1
            saved[whole] += (level["n_convs"][whole] - 1) * level["words"][whole]
            below = level, (children, leaves, saved)
            sums.append(below[1])
        sums.reverse()
        shard = int(self.conv[0])
        above_keys: dict[int, bytes] = {}
        for depth, level in enumerate(self.levels):
            keys: dict[int, bytes] = {}
            children, leaves, saved = sums[depth]
            for i in range(len(level["n_convs"])):
                parent = int(level["parent"][i])
                row = {
                    "shard": shard, "conv_id": int(level["conv_id"][i]), "depth": depth,
                    "n_convs": int(level["n_convs"][i]), "n_children": int(children[i]),
                    "n_leaves": int(leaves[i]), "saved_tokens": int(saved[i]),
                }
                if level["edge"][i]:
                    up = above_keys[parent] if depth else b""
                    at = self.offsets[level["row"][i]] + depth - 1
                    keys[i] = up if not depth else hashlib.blake2b(
                        up + self.ids[at].astype(">u8").tobytes(), digest_size=16).digest()
                    yield row | {
                        "kind": "part", "key": keys[i], "parent_key": up if depth else None,
                        "words": int(level["words"][i]),
                    }
                    ends = level["ends"][i]
                    for s in range(0, len(ends), RUN):
                        some = ends[s : s + RUN]
                        yield {
                            "kind": "run", "key": keys[i], "conv_id": int(some[0]),
                            "run": ",".join(map(str, some.tolist())),
                        }
                else:
                    row["ends_sha256"] = _digest(level["ends"][i])
                    if parent in above_keys:
                        yield row | {"kind": "below", "parent_key": above_keys[parent]}
                    else:
                        least = int(self.levels[depth - 1]["conv_id"][parent])
                        yield row | {"kind": "whole", "parent_conv_id": least}
            above_keys = keys


def shard_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes and parts of nodes of every shard; ``conversations`` is a written table."""
    spark = conversations.sparkSession
    turns = conversations.agg(F.sum(F.size("turns")) + F.count("*")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD))
    schema = arrow_schema(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (
            batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
        flat = ids.flatten()
        halves = np.frombuffer(b"".join(flat.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        made = Shard(
            table.column("conv_id").to_numpy(), offsets,
            halves if len(halves) else np.zeros((1, 2), np.uint64), words.flatten().to_numpy(),
        )
        held = []
        for record in made.records():
            held.append(record)
            if len(held) >= RUN:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return (
        conversations.repartitionByRange(
            shards, F.transform(F.slice("turns", 1, LEAD), lambda t: t["id"]), "conv_id"
        )
        .select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))
        .mapInArrow(run, _PART)
    )


def end_digests(runs: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from sorted runs, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for own, text in zip(
                batch.column("key").to_pylist(), batch.column("run").to_pylist(), strict=True
            ):
                if own != key:
                    if digest is not None:
                        keys.append(key)
                        hashes.append(digest.hexdigest())
                    key, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"]
            )
        if digest is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())],
                ["key", "ends_sha256"],
            )

    return (
        runs.select("key", "conv_id", "run").repartition("key")
        .sortWithinPartitions("key", "conv_id").select("key", "run")
        .mapInArrow(run, "key binary, ends_sha256 string")
    )


def summed_upwards(nodes: DataFrame, depth: int) -> DataFrame:
    """``leaves`` and ``saved`` of each node plus those of all below it, by doubling.

    ``nodes`` has ``key``, ``up`` (the parent's key) and the two; it is a written table.
    """
    reach = 1
    while reach <= depth:
        given = nodes.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = nodes.select(F.col("key").alias("up"), F.col("up").alias("next"))
        nodes = stored(
            nodes.join(given, "key", "left").join(further, "up", "left").select(
                "key", F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "summed",
        )
        reach *= 2
    return nodes


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of ``conversations`` (``conv_id``, ``turns``)."""
    found = stored(shard_nodes(stored(conversations, "conversations")), "shard-nodes")
    parts = stored(
        found.filter("kind = 'part'").groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.first("words").alias("words"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        ),
        "boundary-nodes",
    )
    among = parts.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("more")
    )
    parts = stored(
        parts.join(among, "key", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"),
        "boundary-nodes",
    )
    deepest = parts.agg(F.max("depth")).first()[0] or 0
    sums = summed_upwards(
        stored(
            parts.select(
                "key", F.col("parent_key").alias("up"),
                (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"),
                (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
            ),
            "summed",
        ),
        deepest,
    )
    names = parts.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")
    )
    boundary = (
        parts.drop("n_leaves", "saved_tokens")
        .join(sums.select(
            "key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "key")
        .join(end_digests(found.filter("kind = 'run'")), "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
        .join(names, "parent_key", "left")
    )
    # A shard's nodes below a boundary node get its name by shard and node, so that the
    # children of the root are no hot key.
    near = found.filter("kind = 'part'").select("shard", F.col("key").alias("parent_key"))
    below = found.filter("kind = 'below'").drop("parent_conv_id").join(
        near.join(names, "parent_key"), ["shard", "parent_key"]
    )
    whole = found.filter("kind = 'whole'")
    return whole.select(*NODE).unionByName(below.select(*NODE)).unionByName(boundary.select(*NODE))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of all conversations rebuilt with their family's opening."""
    return trie(with_family_opening(conversations_of(turns)))


#: Remainders of the polynomial that CRC-32 stands on, a bit at a time.
_CRC = """
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
"""

SQL = rf"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
    sha256(strlen(role) || ':' || role || text)[1:32]) AS turns
  FROM named GROUP BY conv_id
), counted AS (
  SELECT *, xor({_CRC}, 4294967295) % 4 AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM counted c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, turns[1:d] AS path, d, len(turns) = d AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), ''))
      AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0
      ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL
), flat AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
), sums AS (
  SELECT path[1:d] AS path, d AS depth, sum(saved) AS saved_tokens,
    count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM flat) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM flat n JOIN sums s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
