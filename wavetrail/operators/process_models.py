"""Process-model checks over many models at once.

Inputs: `processes(doc_id, process_id, is_executable, n_bytes)`,
`nodes(process_id, id, kind, aisle, alternative, variable)` and
`flows(process_id, id, source, target, value)`. Absent attributes are empty.
Every check yields `(process_id, rule, subject)`; a model without a violation
is valid. Every model becomes a thin row with a digest of its elements; graphs that are
equal but for the id of their model are packed and judged once, whatever number of models has them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.identity import valid_id
from wavetrail.operators.ordered import global_positions
from wavetrail.session import is_small, small_side, written

# Element kinds and size limits.
START, END, TASK, GATEWAY, FLOW = (
    "startEvent",
    "endEvent",
    "serviceTask",
    "exclusiveGateway",
    "sequenceFlow",
)
NODE_KINDS = (START, END, TASK, GATEWAY)
MAX_NODES = 500
MAX_BYTES = 1 << 20
# an element takes 16 bytes at least, so no document within the limit has more of them
MAX_ELEMENTS = MAX_BYTES // 16

PID = "process_id"


def _emit(rows: DataFrame, *rules: tuple[str, Column, Column]) -> DataFrame:
    """One output row per rule (name, condition, subject) that holds for a row."""
    entries = [
        F.when(broken, F.struct(F.lit(name).alias("rule"), subject.alias("subject")))
        for name, broken, subject in rules
    ]
    return rows.select(PID, F.explode(F.array_compact(F.array(*entries))).alias("_v")).select(
        PID, "_v.rule", "_v.subject"
    )


def node_rules(nodes: DataFrame) -> DataFrame:
    """Rules on a single node: unknown_element, task_attrs, gateway_variable."""
    kind, alternative = F.col("kind"), F.col("alternative")
    bad_alternative = (alternative != "") & (
        ~valid_id("alternative") | (alternative == F.col("aisle"))
    )
    node = F.col("id")
    return _emit(
        nodes,
        ("unknown_element", ~kind.isin(*NODE_KINDS), node),
        ("task_attrs", (kind == TASK) & (~valid_id("aisle") | bad_alternative), node),
        ("gateway_variable", (kind == GATEWAY) & ~valid_id("variable"), node),
    )


def process_rules(processes: DataFrame) -> DataFrame:
    """Rules on a process and its document: not_executable, size (bytes), process_count."""
    runs = F.coalesce(F.col("is_executable") == "true", F.lit(False))
    single = _emit(
        processes,
        ("not_executable", ~runs, F.col(PID)),
        ("size", F.col("n_bytes") > MAX_BYTES, F.lit("bytes")),
    )
    # one exchange: a count joined back would shuffle all processes a second time
    of_document = F.count("*").over(Window.partitionBy("doc_id"))
    shared = processes.select("doc_id", PID).filter("doc_id is not null").withColumn("_n", of_document).filter("_n != 1")
    return single.unionByName(_emit(shared, ("process_count", F.lit(True), F.col("doc_id"))))


def count_rules(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules on counts per model: size (nodes, elements), start_end, has_tasks."""
    kinds = (
        nodes.select(PID, "kind")
        .unionByName(processes.select(PID, F.lit(None).cast("string").alias("kind")))
        .unionByName(flows.select(PID, F.lit(FLOW).alias("kind")))
    )
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counts = kinds.groupBy(PID).agg(
        F.count("kind").alias("_elements"),
        of(FLOW).alias("_flows"),
        of(START).alias("_starts"),
        of(END).alias("_ends"),
        of(TASK).alias("_tasks"),
    )
    return _emit(
        counts,
        ("size", F.col("_elements") - F.col("_flows") > MAX_NODES, F.lit("nodes")),
        ("size", F.col("_elements") > MAX_ELEMENTS, F.lit("elements")),
        ("start_end", F.col("_starts") != 1, F.lit("start")),
        ("start_end", F.col("_ends") == 0, F.lit("end")),
        ("has_tasks", F.col("_tasks") == 0, F.col(PID)),
    )


def degree_rules(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rule on the incoming and outgoing flows of a node: degrees. One aggregation over thin rows."""
    kind = F.col("kind")
    known = [F.when(kind == k, 1).otherwise(0).cast("long") for k in NODE_KINDS]
    none = F.lit(0).cast("long")
    row = lambda id_, kinds, n_in, n_out: F.struct(
        F.col(id_).alias("id"), *[k.alias(f"_k{i}") for i, k in enumerate(kinds)],
        F.lit(n_in).cast("long").alias("_in"), F.lit(n_out).cast("long").alias("_out"),
    )
    zeros = [none] * len(NODE_KINDS)
    rows = nodes.select(PID, F.inline(F.array(row("id", known, 0, 0)))).unionByName(
        flows.select(PID, F.inline(F.array(row("source", zeros, 0, 1), row("target", zeros, 1, 0))))
    )
    per_id = rows.groupBy(PID, "id").agg(
        *[F.sum(f"_k{i}").alias(f"_k{i}") for i in range(len(NODE_KINDS))],
        F.sum("_in").alias("_in"), F.sum("_out").alias("_out"),
    )
    n_in, n_out = F.col("_in"), F.col("_out")
    allowed = {
        START: (n_in == 0) & (n_out == 1), END: (n_in > 0) & (n_out == 0),
        TASK: (n_in > 0) & (n_out == 1), GATEWAY: (n_in > 0) & (n_out > 1),
    }
    misfit = F.lit(False)
    for i, name in enumerate(NODE_KINDS):
        misfit = misfit | ((F.col(f"_k{i}") > 0) & ~allowed[name])
    return _emit(per_id, ("degrees", misfit, F.col("id")))


def _id_rules(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules on an id within its model: invalid_id, duplicate_id, dangling,
    branch_value_scope, branch_values, degrees.

    Everything known about an id (uses as id, node kinds, incoming and outgoing
    flows, branch values) is summed in one aggregation, combined before the shuffle.
    """
    # plain sums only: they stay in a hash aggregation, unlike collected sets
    sums = ("_ids", "_nodes", "_starts", "_ends", "_tasks", "_gateways", "_in", "_out", "_valued", "_bad")

    def fact(id_: str, **amounts: Column | int) -> Column:
        values = [amounts.get(c, 0) for c in sums]
        return F.struct(
            F.col(id_).alias("id"),
            *[
                (F.lit(v) if isinstance(v, int) else v).cast("long").alias(c)
                for c, v in zip(sums, values)
            ],
        )

    is_kind = lambda kind: F.when(F.col("kind") == kind, 1).otherwise(0)
    as_node = fact(
        "id", _ids=1, _nodes=1, _starts=is_kind(START), _ends=is_kind(END), _tasks=is_kind(TASK),
        _gateways=is_kind(GATEWAY),
    )
    branches = flows.groupBy(PID, "source", "value").agg(F.count("*").alias("_n"))
    bad_value = ~valid_id("value") | (F.col("_n") > 1)
    facts = [
        processes.select(PID, F.inline(F.array(fact(PID, _ids=1)))),
        nodes.select(PID, F.inline(F.array(as_node))),
        flows.select(PID, F.inline(F.array(fact("id", _ids=1), fact("target", _in=1)))),
        branches.select(
            PID,
            F.inline(
                F.array(
                    fact(
                        "source",
                        _out=F.col("_n"),
                        _valued=F.when(F.col("value") != "", F.col("_n")).otherwise(0),
                        _bad=bad_value.cast("int"),
                    )
                )
            ),
        ),
    ]
    union = facts[0]
    for part in facts[1:]:
        union = union.unionByName(part)
    per_id = union.groupBy(PID, "id").agg(*[F.sum(c).alias(c) for c in sums])
    n_in, n_out = F.col("_in"), F.col("_out")
    misfit = (
        ((F.col("_starts") > 0) & ((n_in != 0) | (n_out != 1)))
        | ((F.col("_ends") > 0) & ((n_in == 0) | (n_out != 0)))
        | ((F.col("_tasks") > 0) & ((n_in == 0) | (n_out != 1)))
        | ((F.col("_gateways") > 0) & ((n_in == 0) | (n_out < 2)))
    )
    subject = F.col("id")
    return _emit(
        per_id,
        ("invalid_id", (F.col("_ids") > 0) & ~valid_id("id"), subject),
        ("duplicate_id", F.col("_ids") > 1, subject),
        ("dangling", (n_in + n_out > 0) & (F.col("_nodes") == 0), subject),
        (
            "branch_value_scope",
            (F.col("_valued") > 0) & (F.col("_nodes") > F.col("_gateways")),
            subject,
        ),
        ("branch_values", (F.col("_bad") > 0) & (F.col("_gateways") > 0), subject),
        ("degrees", misfit, subject),
    )


# --- walks ----------------------------------------------------------------


def _walked(start: str, ids: list[str], edges: list[tuple[str, str]]) -> tuple[bool, list[str]]:
    """(a walk from `start` can repeat a node, ids that no walk reaches)."""
    follow: dict[str, list[str]] = {}
    for source, target in edges:
        follow.setdefault(source, []).append(target)
    open_, done, cyclic = {start}, set(), False
    stack = [(start, iter(follow.get(start, ())))]
    while stack:
        node, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            open_.discard(node)
            done.add(node)
        elif step in open_:
            cyclic = True
        elif step not in done:
            open_.add(step)
            stack.append((step, iter(follow.get(step, ()))))
    return cyclic, [i for i in ids if i not in done]


def _walk_batches(batches):
    import pyarrow as pa

    for batch in batches:
        found = [[], [], []]
        for pid, starts, ids, edges in zip(*(batch.column(i).to_pylist() for i in range(4))):
            cyclic, lost = _walked(starts[0], ids, [(e["source"], e["target"]) for e in edges or ()])
            rows = [(pid, "cycle", pid)] * cyclic + [(pid, "unreachable", i) for i in lost]
            for column, values in zip(found, zip(*rows)):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in found], [PID, "rule", "subject"])


def _walk_rules(_: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules on what the start reaches, for models with one start: cycle, unreachable.

    Every model is packed into one row by one shuffle and walked once, in time linear in its
    elements; a join per hop would need one shuffle per node.
    """
    models = nodes.groupBy(PID).agg(
        F.collect_list(F.when(F.col("kind") == START, F.col("id"))).alias("starts"),
        F.collect_set("id").alias("ids"),
    )
    edges = flows.groupBy(PID).agg(F.collect_set(F.struct("source", "target")).alias("edges"))
    packed = models.filter(F.size("starts") == 1).join(edges, PID, "left").select(PID, "starts", "ids", "edges")
    return packed.mapInArrow(_walk_batches, f"{PID} string, rule string, subject string")


class _NumberedGraph:
    """A graph of ids 0, 1, ..., given id by id with the targets of each; the targets stay in a temporary file."""

    def __init__(self, first: int):
        import tempfile
        from array import array

        self.first, self.start, self.offsets, self.n_edges = first, 0, array("q"), 0
        self.targets = tempfile.TemporaryFile()

    def add(self, ids, targets) -> None:
        """Rows sorted by id: (id, `_ID` or `_ONLY_START`), then the edges of the id."""
        import numpy as np

        heads = targets < 0
        before = np.cumsum(~heads)
        self.offsets.frombytes((before[heads] + self.n_edges).astype("int64").tobytes())
        self.n_edges += int(before[-1])
        self.targets.write(targets[~heads].tobytes())
        for start in ids[targets == _ONLY_START]:
            self.start = int(start)

    def walked(self):
        """(a walk from the start can repeat an id, 1 for each id that a walk reaches)."""
        import mmap
        from array import array

        import numpy as np

        offsets = self.offsets
        offsets.append(self.n_edges)
        self.targets.flush()
        targets = memoryview(mmap.mmap(self.targets.fileno(), 0, access=mmap.ACCESS_READ)).cast("q") if self.n_edges else ()
        # 0: not reached, 1: on the path from the start, 2: done
        state, at, path, cyclic = bytearray(len(offsets) - 1), array("q", offsets), array("q", [self.start]), False
        state[self.start] = 1
        while path:
            id_ = path[-1]
            edge = at[id_]
            if edge == offsets[id_ + 1]:
                state[path.pop()] = 2
                continue
            at[id_] = edge + 1
            target = targets[edge]
            if state[target] == 1:
                cyclic = True
            elif not state[target]:
                state[target] = 1
                path.append(target)
        return cyclic, np.frombuffer(state, dtype="uint8") > 0


_ID, _ONLY_START = -1, -2
_FOUND_ROWS = 1 << 16


def _numbered_walks(batches):
    """Rows (first, id, target) of numbered graphs to (first, position): of a lost id, or null for a cycle."""
    import numpy as np
    import pyarrow as pa

    def found(graph):
        cyclic, reached = graph.walked()
        rows = lambda positions: pa.RecordBatch.from_arrays(
            [pa.array([graph.first] * len(positions), pa.int64()), pa.array(positions, pa.int64())], ["first", "position"]
        )
        if cyclic:
            yield rows([None])
        lost = np.flatnonzero(~reached) + graph.first
        for i in range(0, len(lost), _FOUND_ROWS):
            yield rows(lost[i : i + _FOUND_ROWS])

    graph = None
    for batch in batches:
        firsts, ids, targets = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [*(np.flatnonzero(np.diff(firsts)) + 1), len(firsts)] if len(firsts) else []
        for a, b in zip([0, *cuts], cuts):
            if graph is None or graph.first != firsts[a]:
                if graph is not None:
                    yield from found(graph)
                graph = _NumberedGraph(int(firsts[a]))
            graph.add(ids[a:b], targets[a:b])
    if graph is not None:
        yield from found(graph)


IDS_PER_CHUNK = 1_000_000


def large_walk_rules(_: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """`_walk_rules` for named models of any number of elements.

    Ids of elements, those that only flows name included, get their place in the order of all ids by a distributed sort, and flows
    become pairs of numbers by two joins. The pairs of a model then come to one task in sorted order, row by row:
    it keeps 25 bytes per id in memory and the pairs in a temporary file, and walks each pair once.
    """
    none, single = F.lit(0).cast("long"), F.lit(1).cast("long")
    is_start = ((F.col("kind") == START) & F.col("id").isNotNull()).cast("long")
    edges = written(flows.select(PID, "source", "target").distinct(), "large_flows")
    end = lambda c: F.struct(F.col(c).alias("id"), none.alias("_nodes"), none.alias("_starts"))
    ids = nodes.select(PID, "id", single.alias("_nodes"), F.coalesce(is_start, none).alias("_starts")).unionByName(
        edges.select(PID, F.inline(F.array(end("source"), end("target"))))
    )
    ids = written(ids.groupBy(PID, "id").agg(F.sum("_nodes").alias("_nodes"), F.sum("_starts").alias("_starts")), "large_ids")
    placed = written(global_positions(ids, [PID, "id"], -(-ids.count() // IDS_PER_CHUNK)), "placed")
    models = placed.groupBy(PID).agg(F.min("position").alias("first"), F.sum("_starts").alias("_starts"))
    models = small_side(written(models.filter("_starts = 1").select(PID, "first"), "walkable"))
    known = placed.join(models, PID)
    place = F.col("position") - F.col("first")
    heads = known.select("first", place.alias("s"), F.when(F.col("_starts") > 0, _ONLY_START).otherwise(_ID).cast("long").alias("t"))

    def numbered(rows: DataFrame, end: str, name: str) -> DataFrame:
        # a missing id is an id like any other
        ends = placed.select(F.col(PID).alias("_pid"), F.col("id").alias("_id"), F.col("position").alias(name))
        same = (F.col(PID) == F.col("_pid")) & F.col(end).eqNullSafe(F.col("_id"))
        return rows.join(ends, same).drop("_pid", "_id", end)

    pairs = numbered(numbered(edges.join(models, PID), "source", "s"), "target", "t")
    pairs = pairs.select("first", (F.col("s") - F.col("first")).alias("s"), (F.col("t") - F.col("first")).alias("t"))
    rows = heads.unionByName(pairs).repartition("first").sortWithinPartitions("first", "s", "t")
    found = written(rows.mapInArrow(_numbered_walks, "first long, position long"), "walked")
    cyclic = found.filter("position is null").join(models, "first").select(PID, F.lit("cycle").alias("rule"), F.col(PID).alias("subject"))
    lost = found.join(placed.filter((F.col("_nodes") > 0) & F.col("id").isNotNull()), "position")
    return cyclic.unionByName(lost.select(PID, F.lit("unreachable").alias("rule"), F.col("id").alias("subject")))


# --- equal graphs ---------------------------------------------------------

_NODE, _FLOW = ("id", "kind", "aisle", "alternative", "variable"), ("id", "source", "target", "value")
_DIGEST = tuple(f"digest_{i}" for i in range(4))
_CONTENT = ("n_nodes", "n_flows", *_DIGEST)
_OWN = ("n_processes", "n_own", "n_used", "n_refused")
# graphs whose first models are told by a list of hashes, which a filter takes down to the source of their elements
LISTED_GRAPHS = 10_000


class Models(NamedTuple):
    """Models as thin rows, and the tables that hold their elements."""

    rows: DataFrame
    nodes: DataFrame
    flows: DataFrame
    oversize: DataFrame | None


def _element_digest(fields: tuple[str, ...], kind: int) -> list[Column]:
    """Two 64-bit hashes of an element as four numbers below 2^32, whose sums do not overflow.

    The hash skips nulls, so it takes the places of the nulls as a value of its own.
    """
    nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(fields)), F.lit(kind << len(fields)))
    hashes = [F.xxhash64(F.lit(seed), nulls, *fields) for seed in (1, 2)]
    return [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def packed_models(
    processes: DataFrame, nodes: DataFrame, flows: DataFrame, used: DataFrame | None = None,
    refused: DataFrame | None = None,
) -> tuple[Models, DataFrame | None]:
    """One written thin row per model: `n_processes`, `n_own` (elements named like the model), the numbers of its
    nodes and flows and the sums of their hashes; and the oversize models, if there are any.

    Models of the same numbers and sums (128 bits of hash per element) have the same nodes and flows, in any order.
    Numbers and sums are plain sums, combined per task before the one shuffle, so no element is sorted or sent, whatever
    number of them a model has. Models with more elements than a document can hold are listed; the size rule
    reports each of them. With `used` (model ids, which may repeat), only its models are kept, and `n_used` counts them;
    `n_refused` counts the rows of `refused`. Both meet the models in the same shuffle, so no join follows.
    """
    own = F.col("id").eqNullSafe(F.col(PID)).cast("long")
    sums = (*_OWN, *_CONTENT)

    def row(table: DataFrame, **amounts: Column | int) -> DataFrame:
        values = [amounts.get(c, 0) for c in sums]
        return table.select(
            PID, *[(F.lit(v) if isinstance(v, int) else v).cast("long").alias(c) for c, v in zip(sums, values)]
        )

    digest = lambda fields, kind: dict(zip(_DIGEST, _element_digest(fields, kind)))
    rows = row(nodes, n_own=own, n_nodes=1, **digest(_NODE, 0))
    rows = rows.unionByName(row(flows, n_own=own, n_flows=1, **digest(_FLOW, 1)))
    rows = rows.unionByName(row(processes, n_processes=1))
    if used is not None:
        rows = rows.unionByName(row(used.filter(F.col(PID).isNotNull()), n_used=1))
    if refused is not None:
        rows = rows.unionByName(row(refused, n_refused=1))
    models = rows.groupBy(PID).agg(*[F.sum(c).alias(c) for c in sums])
    if used is not None:
        # an id that is only used names no model
        models = models.filter((F.col("n_used") > 0) & (F.col("n_processes") + F.col("n_nodes") + F.col("n_flows") > 0))
    large = F.col(PID).isNotNull() & (F.col("n_nodes") + F.col("n_flows") > MAX_ELEMENTS)
    models = written(models.withColumn("large", large), "models")
    listed = models.filter("large").select(PID, *_OWN)
    listed = None if listed.isEmpty() else small_side(listed)
    return Models(models.filter(~F.col("large")).drop("large"), nodes, flows, listed), listed


def _hash_among(least: DataFrame) -> Column:
    """True for the ids of the first models, and for few others if any.

    A filter, unlike a join, is taken below the generators and computed columns of a table, so nothing is made of
    the models that are not wanted. It is bounded; beyond `LISTED_GRAPHS` the join alone tells them.
    """
    hashes = [r[0] for r in least.select("_hash").limit(LISTED_GRAPHS + 1).collect()]
    if not hashes or len(hashes) > LISTED_GRAPHS:
        return F.lit(True)
    return F.expr(f"xxhash64({PID}) in ({', '.join(f'{h}L' if h > -(1 << 63) else 'long(-9223372036854775808)' for h in hashes)})")


def shared_graphs(models: Models) -> tuple[DataFrame, DataFrame]:
    """Models as two written tables, `keys` and `graphs`.

    `keys`: per model its `graph_id` and its own numbers (`n_processes`, `n_own`, `n_used`, `n_refused`). `graphs`: one row per different graph with `nodes`
    and `flows`, the graph id in the column of the model id. The elements of a graph are those of its first model;
    the elements of the other models are never packed.
    """
    # sums and the least hash of an id stay in a hash aggregation, unlike the least id
    hashed = F.xxhash64(PID).alias("_hash")
    least = models.rows.groupBy(*_CONTENT).agg(F.min(hashed).alias("_hash"))
    least = written(least.withColumn("graph_id", F.monotonically_increasing_id().cast("string")), "contents")
    # the first model of a graph is the one of the least hash; of several with that hash, the least id
    first = models.rows.select(PID, hashed, *_CONTENT).join(small_side(least), [*_CONTENT, "_hash"])
    first = written(first.groupBy("graph_id").agg(F.min(PID).alias("_first")), "first")
    keys = models.rows.join(small_side(least.drop("_hash")), list(_CONTENT)).select(PID, "graph_id", *_OWN)
    named, none = first.select(F.col("_first").alias(PID), "graph_id"), F.lit(None)
    nodes, flows = models.nodes, models.flows
    if is_small(named):
        few = F.broadcast(first.select("_first"))
        nodes, flows = (
            t.filter(told).join(few, F.col(PID).eqNullSafe(F.col("_first")), "left_semi")
            for t, told in ((t, _hash_among(least)) for t in (nodes, flows))
        )
    elif models.oversize is not None:
        # what is left has the bound of a document per model and is combined per task before it is shuffled
        nodes, flows = (t.join(models.oversize.select(PID), PID, "left_anti") for t in (nodes, flows))
    node, flow = F.struct(*_NODE).alias("_n"), F.struct(*_FLOW).alias("_f")
    rows = nodes.select(PID, none.cast("string").alias("graph_id"), node, none.alias("_f"))
    rows = rows.unionByName(flows.select(PID, none.cast("string").alias("graph_id"), none.alias("_n"), flow))
    # a graph may have no elements
    rows = rows.unionByName(named.select(PID, "graph_id", none.alias("_n"), none.alias("_f")))
    graphs = rows.groupBy(PID).agg(
        F.max("graph_id").alias("graph_id"), F.collect_list("_n").alias("nodes"), F.collect_list("_f").alias("flows")
    ).filter(F.col("graph_id").isNotNull())
    return written(keys, "keys"), written(graphs.select(F.col("graph_id").alias(PID), "nodes", "flows"), "graphs")


def graph_rules(models: Models, *checks) -> DataFrame:
    """Violations that the checks find in packed models; the id of a model takes no part in them."""
    return judged_graphs(*shared_graphs(models), *checks)


def found_in_graphs(graphs: DataFrame, *checks) -> DataFrame:
    """What the checks find in graphs, each under its own id."""
    tables = (graphs.select(PID), graphs.select(PID, F.inline("nodes")), graphs.select(PID, F.inline("flows")))
    found = checks[0](*tables)
    for check in checks[1:]:
        found = found.unionByName(check(*tables))
    return found.select(F.col(PID).alias("graph_id"), "rule", "subject")


def _own_subject(rule: str, subject: str) -> Column:
    """The subject of a finding in the graph of a model; these rules name the model itself."""
    return F.when(F.col(rule).isin("has_tasks", "cycle"), F.col(PID)).otherwise(F.col(subject))


def judged_graphs(keys: DataFrame, graphs: DataFrame, *checks) -> DataFrame:
    """`graph_rules` of shared graphs: each is judged once under its own id, and what was found is joined back."""
    found = found_in_graphs(graphs, *checks)
    broken = found.groupBy("graph_id").agg(F.collect_list(F.struct("rule", "subject")).alias("_found"))
    broken = small_side(written(broken, "broken"))
    rows = keys.select(PID, "graph_id").join(broken, "graph_id").select(PID, F.inline("_found"))
    return rows.select(PID, "rule", _own_subject("rule", "subject").alias("subject"))


def _node_rules(_: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    return node_rules(nodes)


def _element_id_rules(_: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    return _id_rules(nodes.select(PID).limit(0), nodes, flows)


def _id_conditions() -> tuple[Column, Column]:
    """invalid_id and duplicate_id of the id of a model, where its elements alone do not break them."""
    judged = (F.col("n_processes") > 0) & (F.col("n_own") < 2)
    return (
        judged & (F.col("n_own") == 0) & ~valid_id(PID),
        judged & (F.col("n_processes") + F.col("n_own") > 1),
    )


def _model_id_rules(keys: DataFrame) -> DataFrame:
    invalid, duplicate = _id_conditions()
    return _emit(keys, ("invalid_id", invalid, F.col(PID)), ("duplicate_id", duplicate, F.col(PID)))


def _with_oversize(found: DataFrame, listed: DataFrame | None, tables: tuple, *checks) -> DataFrame:
    """`found` and the violations of the oversize models, whose rows are never packed."""
    if listed is not None:
        listed = listed.select(PID)
        large = [t.join(listed, PID, "left_semi") for t in tables]
        for check in checks:
            found = found.unionByName(check(*large))
    return found


def id_rules(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules on an id within its model: invalid_id, duplicate_id, dangling,
    branch_value_scope, branch_values, degrees."""
    models, listed = packed_models(processes, nodes, flows)
    found = graph_rules(models, _element_id_rules).unionByName(_model_id_rules(models.rows))
    return _with_oversize(found, listed, (processes, nodes, flows), _id_rules)


def walk_rules(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules on what the start reaches, for models with one start: cycle, unreachable."""
    none = nodes.select(PID).limit(0)
    models, listed = packed_models(none, nodes, flows)
    return _with_oversize(graph_rules(models, _walk_rules), listed, (none, nodes, flows), large_walk_rules)


# --- everything -----------------------------------------------------------

# Order in which the first violation of a model is named.
RULE_ORDER = (
    "unknown_element",
    "not_executable",
    "process_count",
    "invalid_id",
    "size",
    "duplicate_id",
    "start_end",
    "task_attrs",
    "gateway_variable",
    "dangling",
    "branch_value_scope",
    "degrees",
    "branch_values",
    "cycle",
    "unreachable",
    "has_tasks",
)


_GRAPH_CHECKS = (count_rules, _node_rules, _element_id_rules, _walk_rules)


def packed_violations(keys: DataFrame, graphs: DataFrame) -> DataFrame:
    """Violations of every rule on nodes, flows and ids of packed models."""
    return judged_graphs(keys, graphs, *_GRAPH_CHECKS).unionByName(_model_id_rules(keys))


def refused_models(keys: DataFrame, graphs: DataFrame) -> DataFrame:
    """`keys` with `refused`: a model has a violation, of its graph, of its id or one that `n_refused` counts."""
    broken = found_in_graphs(graphs, *_GRAPH_CHECKS).select("graph_id").distinct().withColumn("_broken", F.lit(True))
    invalid, duplicate = _id_conditions()
    refused = F.coalesce("_broken", F.lit(False)) | invalid | duplicate | (F.col("n_refused") > 0)
    return keys.join(small_side(written(broken, "broken")), "graph_id", "left").withColumn("refused", refused).drop("_broken")


def model_violations(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Violations of every rule."""
    models, listed = packed_models(processes, nodes, flows)
    found = process_rules(processes).unionByName(packed_violations(*shared_graphs(models)))
    checks = (count_rules, _node_rules, _id_rules, large_walk_rules)
    return _with_oversize(found, listed, (processes, nodes, flows), *checks)


def _placed(rule: Column, subject: Column) -> Column:
    """A violation that sorts by checking order."""
    place = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), rule)
    return F.struct(place.alias("place"), rule.alias("rule"), subject.alias("subject"))


def first_violation(violations: DataFrame) -> DataFrame:
    """Per invalid model the first rule, in checking order, that it breaks."""
    placed = _placed(F.col("rule"), F.col("subject"))
    return violations.groupBy(PID).agg(F.min(placed).alias("_v")).select(PID, "_v.rule", "_v.subject")


def first_violations(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """`first_violation` of all violations, of which only the first one of each graph goes to its models.

    An oversize model is not walked: it breaks the size rule, which comes before those of the walk.
    """
    models, listed = packed_models(processes, nodes, flows)
    keys, graphs = shared_graphs(models)
    found = found_in_graphs(graphs, *_GRAPH_CHECKS).withColumnRenamed("graph_id", PID)
    first = first_violation(found).select(F.col(PID).alias("graph_id"), F.col("rule").alias("_rule"), F.col("subject").alias("_subject"))
    judged = keys.join(small_side(written(first, "broken")), "graph_id", "left")
    invalid, duplicate = _id_conditions()
    least = F.least(
        F.when(F.col("_rule").isNotNull(), _placed(F.col("_rule"), _own_subject("_rule", "_subject"))),
        F.when(invalid, _placed(F.lit("invalid_id"), F.col(PID))),
        F.when(duplicate, _placed(F.lit("duplicate_id"), F.col(PID))),
    )
    rows = judged.select(PID, least.alias("_v")).filter(F.col("_v").isNotNull()).select(PID, "_v.rule", "_v.subject")
    rows = rows.unionByName(process_rules(processes))
    return first_violation(_with_oversize(rows, listed, (processes, nodes, flows), count_rules, _node_rules, _id_rules))


def document_refused(processes: DataFrame, document_violations: DataFrame | None) -> DataFrame | None:
    """Ids of models from a document with a violation."""
    if document_violations is None:
        return None
    documents = document_violations.select("doc_id").distinct()
    return processes.join(documents, "doc_id", "left_semi").select(PID)


def valid_models(
    processes: DataFrame, nodes: DataFrame, flows: DataFrame, document_violations: DataFrame | None = None
) -> DataFrame:
    """Ids of models without any violation, of the graph or of their document."""
    broken = model_violations(processes, nodes, flows).select(PID)
    refused = document_refused(processes, document_violations)
    if refused is not None:
        broken = broken.unionByName(refused)
    return processes.select(PID).join(broken.distinct(), PID, "left_anti")


def canonical_order(rows: DataFrame) -> DataFrame:
    """Nodes or flows sorted by model and id."""
    return rows.orderBy(PID, "id")


def task_catalog(nodes: DataFrame) -> DataFrame:
    """Task ids per model, one row each: a model may have any number."""
    return nodes.filter(F.col("kind") == TASK).select(PID, F.col("id").alias("task_id")).distinct()


def model_summary(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Number of nodes and flows per model."""
    n = nodes.groupBy(PID).agg(F.count("*").alias("n_nodes"))
    f = flows.groupBy(PID).agg(F.count("*").alias("n_flows"))
    joined = processes.select(PID).join(n, PID, "left").join(f, PID, "left")
    return joined.fillna(0, ["n_nodes", "n_flows"])


def catalog_drift(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Catalog rows that are only stored or only computed; none when nothing drifted.

    One signed count over both sides, combined before the shuffle.
    """
    columns = stored.columns
    signed = stored.withColumn("_s", F.lit(1)).unionByName(computed.withColumn("_s", F.lit(-1)))
    counts = signed.groupBy(*columns).agg(F.sum("_s").alias("_s")).filter("_s <> 0")
    return counts.select(*columns, F.when(F.col("_s") > 0, "stored").otherwise("computed").alias("side"))
