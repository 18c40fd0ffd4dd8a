"""N-gram Jaccard self-join by prefix trees, and the components of its links.

Every text is a set of hashed 5-word shingles in one global order. Two sets link at Jaccard 0.8 or more. The join is
exact and its steps are:

1. Texts with the same set are one class, known by the set's fingerprint; only its smallest id goes on.
2. By the prefix lemma, linked sets share tokens among the first fifth (and a little) of each in hash order. A set with
   too few shared tokens there links with nothing and is dropped. Tasks first settle their own tokens, so that a token
   of very many texts leaves a task once per chunk.
3. For the rest, tokens are counted exactly. In rare-first order, a set whose tokens of its own outnumber the allowed
   difference has no prefix left and is dropped as well.
4. The centre of a prefix token is the set with the fewest tokens of its own; sets are around the centres of their
   prefix tokens. Sets are checked by prefix trees: blocks of sets form a tree over the ordered tokens; a probing set's
   walk shares the partial overlaps of common beginnings and leaves subtrees that can no longer reach the overlap that
   0.8 needs. First each centre probes the sets around it.
5. Sets that are connected by then need no more checks. Around each centre, the sets outside its largest component
   probe blocks of all sets around it, walking past subtrees of their own component. Probes are cut into chunks as
   members are into blocks, so one task's unit of work is bounded whatever the group's size. Only links leave a task,
   never all pairs of a group, and no link between different components is lost. A common token is in a prefix only of
   sets that have few rarer tokens, four fifths of which are then common passages; such sets mostly link with the centre.

The joins of rows, tokens and sets are merge joins at every size, so that small tables take the way that large ones take.
Each step's result is written, its shuffle files are removed then, and tables that nothing reads any more are deleted. In step 2, a token has as many rows as there are chunks of texts that hold it, about 30 MB each.

Defined cases: keys may be of any type that has an order; an empty or null text has an empty set and links with nothing; under five words, the whole sequence is one
item; very long texts are read whole; repeated rows are of one class; a row with a null id links with nothing and has a
null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from veilframe.llm.common import KERNEL_BYTES, cut, dropping, map_text, materialize
from veilframe.llm.components import components

WORDS = 5
#: 100 * intersection >= PERCENT * union makes a link.
PERCENT = 80
#: Prefixes of step 2 are longer by this share, and so many more shared tokens are asked for (times PERCENT).
EXTRA = 0.05
#: Partners in a prefix tree, and probes that walk it in one unit of work, about.
BLOCK = 128
#: Tokens of a run that a walk counts before it looks at the bound again.
STEP = 48

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's word windows; under `words` words, of the whole sequence."""
    import xxhash

    found = text.encode("utf-8", "replace").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=n)
    size = min(n, words)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = (out ^ (out >> B)) * A + h[k : n - size + 1 + k]
        out = (out ^ (out >> B)) * A
    return np.unique(out.view(np.int64))


def allowed(n: np.ndarray | int):
    """Tokens of a set that a partner may lack, at most: n - ceil(PERCENT * n / 100)."""
    return n - -(-PERCENT * n // 100)


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, fp, near, owned, shared): a row per document. owned: prefix tokens whose first holder in its chunk it is.

    shared has for each owned token whether its chunk has settled that it is shared; near counts the settled ones.
    """
    kept = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = kept.schema["__key"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in cut(whole, "__text", 2 * KERNEL_BYTES):
                sets = [shingles(t) for t in b.column(1).to_pylist()]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                first: dict[bytes, int] = {}
                for i, p in enumerate(prints):
                    first.setdefault(p, i)
                at = [i for i in first.values() if len(sets[i])]
                parts = [sets[i][: min(len(sets[i]), int(allowed(len(sets[i]))) + 1 + int(EXTRA * len(sets[i])))] for i in at]
                near, owned, settled = [0] * len(sets), [[]] * len(sets), [[]] * len(sets)
                if at:
                    holder = np.repeat(np.arange(len(at)), [len(p) for p in parts])
                    _, firsts, inverse, n = np.unique(np.concatenate(parts), return_index=True, return_inverse=True, return_counts=True)
                    twice = n[inverse] > 1
                    own = np.zeros(len(holder), dtype=bool)
                    own[firsts] = True
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    for j, i in enumerate(at):
                        sl = slice(starts[j], starts[j + 1])
                        near[i] = int(twice[sl].sum())
                        owned[i] = parts[j][own[sl]]
                        settled[i] = twice[sl][own[sl]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(near, pa.int64()), pa.array(owned, pa.list_(pa.int64())), pa.array(settled, pa.list_(pa.bool_()))], names=["__key", "n", "fp", "near", "owned", "settled"])

    return kept.mapInArrow(run, f"__key {kind}, n long, fp binary, near long, owned array<long>, settled array<boolean>")


def short_list(rows: DataFrame) -> DataFrame:
    """Step 2: the fingerprints of sets with enough shared prefix tokens."""
    held = rows.where(F.col("n") > 0).select("fp", F.explode(F.arrays_zip("owned", "settled")).alias("x")).select(F.xxhash64("fp").alias("f"), F.col("x.owned").alias("token"), F.col("x.settled").alias("settled"))
    by = Window.partitionBy("token")
    # a task hands on a token once for each chunk, so a token has as many rows as there are chunks at most
    wide = held.withColumns({"lo": F.min("f").over(by), "hi": F.max("f").over(by)}).where("lo <> hi and not settled").groupBy("f").agg(F.count(F.lit(1)).alias("far"))
    local = rows.where("near > 0 or n > 0").groupBy("fp").agg(F.max("near").alias("near"), F.first("n").alias("n"), F.min("__key").alias("rid")).withColumn("f", F.xxhash64("fp"))
    least = 1 + F.floor(F.col("n") * (EXTRA * PERCENT / 100) - 1e-9)
    return local.join(wide.hint("merge"), "f", "left").where(F.col("near") + F.coalesce("far", F.lit(0)) >= F.greatest(least, F.lit(1))).select("rid", "fp")


def sets_of(df: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, n, tokens) of the chosen classes, from the text of their smallest id."""
    rows = df.select(F.col(key).alias("rid"), F.col(text).alias("__text")).where(F.col("rid").isNotNull()).join(chosen.hint("merge"), "rid")

    def factory():
        def kernel(texts):
            sets = [shingles(t) for t in texts]
            return {"tokens": sets, "own": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]}

        return kernel

    out = map_text(rows, factory, "tokens array<long>, own binary", ["rid", "fp"], "__text")
    return out.where("own = fp").select("rid", F.size("tokens").cast("long").alias("n"), "tokens")


def postings(sets: DataFrame) -> DataFrame:
    """Step 3: (token, rid, n, sh) for the prefix tokens in rare-first order; sh: tokens that other sets have too."""
    rows = sets.select("rid", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(counts.hint("merge"), "token").groupBy("rid", "n").agg(F.collect_list(F.struct("df", "token")).alias("of"))
    sh = F.size("of").cast("long")
    spare = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - sh)
    return shared.withColumns({"sh": sh, "spare": spare.cast("int")}).where("spare > 0").select(F.explode(F.slice(F.sort_array("of"), F.lit(1), F.col("spare"))["token"]).alias("token"), "rid", "n", "sh")


def feasible(n_a: Column, sh_a: Column, n_b: Column, sh_b: Column) -> Column:
    most = F.least(sh_a, sh_b)
    return 100 * most >= PERCENT * (n_a + n_b - most)


class SetTree:
    """A prefix tree of sorted token arrays; a node has a run of tokens, the sizes and the component below it, its own sets."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        self.root = self.build(sorted(sets, key=lambda s: s[2].tolist()), 0)

    def build(self, sets: list[tuple[int, int, np.ndarray]], depth: int) -> dict:
        a, b = sets[0][2][depth:], sets[-1][2][depth:]
        m = min(len(a), len(b))
        differ = np.nonzero(a[:m] != b[:m])[0]
        common = int(differ[0]) if len(differ) else m
        end = depth + common
        kinds = {c for _, c, _ in sets}
        node = {"run": a[:common], "start": depth, "min": min(len(s) for *_, s in sets), "max": max(len(s) for *_, s in sets), "of": kinds.pop() if len(kinds) == 1 else None, "ids": [(i, c, len(s)) for i, c, s in sets if len(s) == end], "below": []}
        rest, start = [s for s in sets if len(s[2]) > end], 0
        for k in range(1, len(rest) + 1):
            if k == len(rest) or rest[k][2][end] != rest[start][2][end]:
                node["below"].append(self.build(rest[start:k], end))
                start = k
        return node

    def walk(self, probe: np.ndarray, own: int) -> list[tuple[int, int]]:
        """(id, component) of the sets that link with probe and aren't of its own component."""
        out, n, stack = [], len(probe), [(self.root, 0, 0)]
        while stack:
            node, overlap, passed = stack.pop()
            if node["of"] == own:
                continue
            run, at, alive = node["run"], node["start"], True
            for k in range(0, len(run) + 1, STEP):
                # the overlap that the longest set below may still reach, against the shortest union
                most = overlap + min(node["max"] - at, n - passed)
                if not linked(most, n, max(node["min"], most)):
                    alive = False
                    break
                part = run[k : k + STEP]
                if len(part):
                    found = np.searchsorted(probe, part)
                    overlap += int((probe[np.minimum(found, n - 1)] == part).sum())
                    passed = int(np.searchsorted(probe, part[-1], side="right"))
                    at += len(part)
            if alive:
                out += [(i, c) for i, c, size in node["ids"] if c != own and linked(overlap, n, size)]
                stack += [(x, overlap, passed) for x in node["below"]]
        return out


def probed(members: DataFrame, probes: DataFrame, sets: DataFrame) -> DataFrame:
    """Members and probes (group, block, chunk, id, component); links (u, v) of a probe to one set of each component.

    A unit is a block of members and a chunk of probes, both bounded by their makers; a task holds one block's tree at a
    time and the chunk's probes stream past it.
    """
    rows = materialize(members.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1))), "join-blocks")
    unit = ["group", "block", "chunk"]
    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)
    rows = rows.hint("merge").join(sets.select(F.col("rid").alias("id"), "tokens"), "id").select(*unit, "role", "id", "component", "tokens")

    def run(batches):
        group, held, tree = None, [], None
        for b in batches:
            tokens = b.column(6)
            starts, flat, us, vs = tokens.offsets.to_numpy(), tokens.values.to_numpy(), [], []
            for k, (*now, role, i, c) in enumerate(zip(*(b.column(j).to_pylist() for j in range(6)))):
                if now != group:
                    group, held, tree = now, [], None
                s = flat[starts[k] : starts[k + 1]]
                if role == 0:
                    held.append((i, c, s.copy()))
                elif held:
                    tree = tree or SetTree(held)
                    for v, _ in {x: (v, x) for v, x in tree.walk(s, c)}.values():
                        us.append(i)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, arrow), pa.array(vs, arrow)], names=["u", "v"])

    return rows.repartition(*unit).sortWithinPartitions(*unit, "role").mapInArrow(run, StructType([StructField("u", kind), StructField("v", kind)]))


def star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each centre a to its partners b, dealt to blocks of about BLOCK partners."""
    blocks = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    chunk = F.lit(0).cast("long").alias("chunk")
    members = stars.join(blocks, "a").select(F.col("a").alias("group"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), chunk, F.col("b").alias("id"), F.col("b").alias("component"))
    probes = blocks.select(F.col("a").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk, F.col("a").alias("id"), F.col("a").alias("component"))
    return probed(members, probes, sets)


def cross_links(around: DataFrame, sets: DataFrame) -> DataFrame:
    """Step 5: links between different components among the sets around (group, id, component) each centre.

    The largest component of a group and all others get blocks of their own; only the others' sets are probes. The k-th
    chunk of probes has the sets of the others' k-th block and meets the main blocks and the others' blocks from the
    k-th on, so two sets meet once and members are copied once for each chunk of up to about BLOCK probes.
    """
    sizes = around.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where("kinds > 1")
    shape = shape.select("group", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("others"))
    rows = around.join(shape, "group")
    is_main, zero = F.col("component") == F.col("main"), F.lit(0).cast("long")
    nth = F.pmod(F.xxhash64("id"), F.col("others"))
    block = F.when(is_main, F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.col("mains") + nth)
    members = rows.select("group", block.alias("block"), F.explode(F.sequence(zero, F.when(is_main, F.col("others") - 1).otherwise(nth))).alias("chunk"), "id", "component")
    met = F.concat(F.sequence(zero, F.col("mains") - 1), F.sequence(F.col("mains") + nth, F.col("mains") + F.col("others") - 1))
    probes = rows.where(~is_main).select("group", F.explode(met).alias("block"), nth.alias("chunk"), "id", "component")
    return probed(members, probes, sets)


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id, one row per row of df."""
    with dropping(digests(df, key, text), "join-digests") as made:
        chosen = materialize(short_list(made.where(F.col("__key").isNotNull())), "join-chosen")
        rows = materialize(made.select("__key", "n", "fp"), "join-rows")
    sets = materialize(sets_of(df, chosen, key, text), "join-sets")
    posted = materialize(postings(sets), "join-postings")
    centre = posted.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("sh")).alias("own"), "rid", "n", "sh")).alias("c"))
    # a set is around the centre of each of its prefix tokens; two sets with a common prefix token have a common centre
    around = posted.join(centre.hint("merge"), "token").groupBy(F.col("c.rid").alias("group"), F.col("rid").alias("id")).agg(F.first(feasible(F.col("n"), F.col("sh"), F.col("c.n"), F.col("c.sh"))).alias("may_link"))
    around = materialize(around, "join-around")
    stars = around.where((F.col("group") != F.col("id")) & F.col("may_link")).select(F.col("group").alias("a"), F.col("id").alias("b"))
    joined = components(materialize(star_links(stars, sets), "join-links"))
    # centres of one component make one group, so that a set is in few groups
    known = around.select("group", "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_centre = joined.select(F.col("id").alias("group"), F.col("component").alias("whole"))
    known = known.join(of_centre, "group", "left").select(F.coalesce("whole", "group").alias("group"), "id", "component").distinct()
    more = materialize(cross_links(materialize(known, "join-known"), sets), "join-more")
    final = components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).where("u <> v").unionByName(more), "components-final")
    classes = rows.where(F.col("__key").isNotNull() & (F.col("n") > 0)).groupBy("fp").agg(F.min("__key").alias("rid"))
    classes = classes.join(final.withColumnRenamed("id", "rid"), "rid", "left").select("fp", F.coalesce("component", "rid").alias("component_id"))
    # empty sets stay out of the join: they may be very many, all with one fingerprint
    is_empty = F.col("n") == 0
    whole = rows.where(~is_empty).select("__key", "n", "fp").join(classes.hint("merge"), "fp", "left").select("__key", "n", F.when(F.col("__key").isNotNull(), F.col("component_id")).alias("component_id"))
    out = whole.unionByName(rows.where(is_empty).select("__key", "n", F.col("__key").alias("component_id")))
    return out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), "component_id")


#: The same rows by brute force, for DuckDB; quadratic in the size of groups, so for small tables.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
m AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT m.v, r.c FROM r JOIN m ON m.u = r.id AND r.c < m.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY ALL
"""
