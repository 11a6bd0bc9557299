"""Task-graph operators for orchestration requests.

Input: ``tasks(request_id, pos, task_id, task_type, priority, depends_on)``
with ``depends_on`` an array of task ids (a single nullable id is accepted and
wrapped). ``pos`` is the 1-based place in the request's list.

The ordering rule is sequential by nature: take again and again the first
listed task, not yet taken, whose dependencies are all taken; when none is
ready, append every remaining task (id not yet taken) in list order and flag
a cycle; rows repeating a taken id are dropped. (This is the lexicographically
first topological order, a P-complete problem, so a request is one unit of
work.) One ``groupBy(request_id)`` gathers each request's list once; every
derived answer (dependency order, priority order, violations, execution mode,
pending tasks, roll-up) is an array expression over that row — no further
shuffle. A request whose listed order already satisfies every dependency
keeps it (checked in one pass; the rule provably returns the list), other
requests take the array fold, and those longer than ``array_limit`` an
O((n + e) log n) heap in a pandas UDF instead of the O(n^3) fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import fixed
from ..functions.text import fixed_digits
from ..session import input_partitions, materialize

ELEM = "struct<pos:int,task_id:string,task_type:string,priority:int,deps:array<string>>"

DEFAULT_ARRAY_LIMIT = 64


def normalise_tasks(tasks: DataFrame) -> DataFrame:
    """Give ``depends_on`` the array shape (a NULL id means no dependency)."""
    dep = F.col("depends_on")
    if not isinstance(tasks.schema["depends_on"].dataType, ArrayType):
        dep = F.when(dep.isNull(), F.array().cast("array<string>")).otherwise(F.array(dep))
    else:
        dep = F.coalesce(dep, F.array().cast("array<string>"))
    if "parallel_requested" not in tasks.columns:
        tasks = tasks.withColumn("parallel_requested", F.lit(True))
    return tasks.select("request_id", F.col("pos").cast("int").alias("pos"), "task_id", "task_type",
                        F.col("priority").cast("int").alias("priority"), dep.alias("deps"),
                        "parallel_requested")


def unfold_requests(requests: DataFrame) -> DataFrame:
    """G1: ``(request_id, tasks ARRAY<STRUCT>)`` → one row per task in list order."""
    return (requests.select("request_id", F.posexplode("tasks").alias("p", "t"))
            .select("request_id", (F.col("p") + 1).cast("int").alias("pos"), "t.*"))


def _in_order(tasks: Column, ids: Column) -> Column:
    """True where the list is its own order, exactly: with unique ids and every
    dependency listed before its task, task i is always the first ready one at
    step i, so the rule returns the list unchanged and no cycle."""
    return (F.size(F.array_distinct(ids)) == F.size(tasks)) & F.forall(
        F.transform(tasks, lambda x, i: F.struct(x["deps"].alias("deps"), i.alias("i"))),
        lambda y: F.forall(y["deps"], lambda d: F.array_position(ids, d).between(1, y["i"])))


def _order_fold(tasks: Column) -> Column:
    """The ordering rule as a fold over ``sequence(1, n)`` on a sorted array: ``struct(order, cycle)``."""
    n = F.size(tasks)
    init = F.struct(F.array().cast("array<string>").alias("taken"),
                    F.array().cast(f"array<{ELEM}>").alias("order"),
                    F.lit(False).alias("done"), F.lit(False).alias("cycle"))

    none = F.lit(None).cast(ELEM)

    def step(acc, _i):
        taken = acc["taken"]
        # first ready task in list order; the AND short-circuits once found
        first_ready = F.aggregate(tasks, none, lambda best, x: F.when(
            best.isNull() & ~F.array_contains(taken, x["task_id"])
            & F.forall(x["deps"], lambda d: F.array_contains(taken, d)), x).otherwise(best))

        def advance(acc2, first):
            took = F.struct(F.concat(taken, F.array(first["task_id"])).alias("taken"),
                            F.concat(acc2["order"], F.array(first)).alias("order"),
                            F.lit(False).alias("done"), acc2["cycle"].alias("cycle"))
            rest = F.filter(tasks, lambda x: ~F.array_contains(taken, x["task_id"]))
            stuck = F.struct(taken.alias("taken"), F.concat(acc2["order"], rest).alias("order"),
                             F.lit(True).alias("done"), F.lit(True).alias("cycle"))
            return F.when(first.isNull(), stuck).otherwise(took)

        # a one-element fold binds the pick once (a "let"), so it is not recomputed
        moved = F.aggregate(F.array(first_ready), acc, advance)
        return F.when(acc["done"] | (F.size(acc["order"]) >= n), acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), init, step,
                       lambda acc: F.struct(acc["order"].alias("order"), acc["cycle"].alias("cycle")))


def _order_heap(rows: list) -> tuple[list, bool]:
    """The same rule for a large request, with a min-heap of ready positions."""
    import heapq

    waiting = []           # unmet dependency count per row
    dependants: dict[str, set[int]] = {}
    for i, r in enumerate(rows):
        deps = list(r["deps"]) if r["deps"] is not None else []
        waiting.append(len(deps))
        for d in deps:
            dependants.setdefault(d, set()).add(i)
    heap = [i for i, w in enumerate(waiting) if w == 0]
    heapq.heapify(heap)
    taken: set[str] = set()
    order = []
    while len(order) < len(rows):
        while heap and rows[heap[0]]["task_id"] in taken:
            heapq.heappop(heap)
        if not heap:
            return order + [r for r in rows if r["task_id"] not in taken], True
        pick = rows[heapq.heappop(heap)]
        taken.add(pick["task_id"])
        order.append(pick)
        for j in sorted(dependants.get(pick["task_id"], ())):
            # a dependency is met once, when its id is first taken
            waiting[j] -= sum(1 for d in rows[j]["deps"] if d == pick["task_id"])
            if waiting[j] == 0:
                heapq.heappush(heap, j)
    return order, False


def _large_order(tasks: Column) -> Column:
    """``struct(order, cycle)`` of the requests that are not null, by the heap."""
    @F.pandas_udf(f"order array<{ELEM}>, cycle boolean")
    def heap(lists: pd.Series) -> pd.DataFrame:
        found = [(None, None) if rows is None else _order_heap(list(rows)) for rows in lists]
        return pd.DataFrame({"order": [o for o, _ in found], "cycle": pd.Series([c for _, c in found], dtype=object)})

    # kept out of the expressions that read its result, where it could not be evaluated
    return heap.asNondeterministic()(tasks)


def plan_requests(tasks: DataFrame, array_limit: int = DEFAULT_ARRAY_LIMIT) -> DataFrame:
    """G2 core: one row per request with its dependency order.

    Columns: request_id, n_rows (all listed rows), cycle, order_tasks (array of
    task structs in dependency order), parallel_requested, has_dependencies
    (any listed row has a dependency). Requests of more than ``array_limit``
    rows that are not listed in order go through the heap, which sees null for
    all others: one aggregation, whatever the sizes.
    """
    # Explicit hash partitioning on the request: the groupBy reuses it (on a
    # stored table it replaces the aggregate's own exchange), and the
    # CPU-bound fold keeps at least one partition per core, and more the
    # larger the input is, instead of the few that AQE's byte-based coalescing
    # would leave.
    t = normalise_tasks(tasks).repartition(input_partitions(tasks), "request_id")
    grouped = t.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "task_id", "task_type", "priority", "deps")))
        .alias("tasks"),
        F.bool_and("parallel_requested").alias("parallel_requested"),
        F.bool_or(F.size("deps") > 0).alias("has_dependencies"))
    listed = grouped.withColumn("_ids", F.transform("tasks", lambda x: x["task_id"]))
    listed = listed.withColumn("_listed", _in_order(F.col("tasks"), F.col("_ids")))
    large = (F.size("tasks") > array_limit) & ~F.col("_listed")
    sent = listed.withColumn("_heap", _large_order(F.when(large, F.col("tasks"))))
    fold = F.when(F.col("_listed"), F.struct(F.col("tasks").alias("order"), F.lit(False).alias("cycle"))).when(
        F.col("_heap.order").isNull(), _order_fold(F.col("tasks"))).otherwise(F.col("_heap"))
    planned = sent.withColumn("f", fold)
    return planned.select("request_id", F.size("tasks").cast("int").alias("n_rows"), F.col("f.cycle").alias("cycle"),
                          F.col("f.order").alias("order_tasks"), "parallel_requested", "has_dependencies")


def with_priority_order(plan: DataFrame) -> DataFrame:
    """Stable sort of the dependency order by priority, high first.

    Adds ``exec_tasks``: structs with ``ord`` (dependency order) and
    ``exec_ord`` (final order). This can place a task before a dependency.
    """
    indexed = F.transform("order_tasks", lambda x, i: F.struct(
        (i + 1).cast("int").alias("ord"), x["pos"].alias("pos"), x["task_id"].alias("task_id"),
        x["task_type"].alias("task_type"), x["priority"].alias("priority"), x["deps"].alias("deps")))
    ranked = F.array_sort(indexed, lambda l, r: F.when(l["priority"] > r["priority"], -1)
                          .when(l["priority"] < r["priority"], 1)
                          .otherwise(l["ord"] - r["ord"]))
    exec_tasks = F.transform(ranked, lambda x, i: x.withField("exec_ord", (i + 1).cast("int")))
    return plan.withColumn("exec_tasks", exec_tasks)


def order_tasks(plan: DataFrame) -> DataFrame:
    """G2 rows: request_id, ord, pos, task_id, task_type, priority, cycle."""
    return (plan.select("request_id", "cycle", F.posexplode("order_tasks").alias("i", "t"))
            .select("request_id", (F.col("i") + 1).cast("int").alias("ord"), "t.pos", "t.task_id",
                    "t.task_type", "t.priority", "cycle"))


def priority_order(plan: DataFrame) -> DataFrame:
    """G3 rows: request_id, exec_ord, ord, pos, task_id, task_type, priority."""
    p = plan if "exec_tasks" in plan.columns else with_priority_order(plan)
    return (p.select("request_id", F.explode("exec_tasks").alias("t"))
            .select("request_id", "t.exec_ord", "t.ord", "t.pos", "t.task_id", "t.task_type", "t.priority"))


def dependency_violations(plan: DataFrame) -> DataFrame:
    """(task, dependency) pairs where the final order runs the task first.

    Resolved inside each request's array (position of the dependency's id),
    so it needs no self-join.
    """
    p = plan if "exec_tasks" in plan.columns else with_priority_order(plan)
    # the id list is a column of its own, so the nested lambdas read it
    # instead of rebuilding it for every (task, dependency) pair
    p = p.withColumn("_ids", F.transform("exec_tasks", lambda x: x["task_id"]))
    ids = F.col("_ids")
    pairs = F.flatten(F.transform("exec_tasks", lambda x: F.transform(
        x["deps"], lambda d: F.struct(x["task_id"].alias("task_id"), d.alias("depends_on"),
                                      x["exec_ord"].alias("task_exec_ord"),
                                      F.array_position(ids, d).cast("int").alias("dep_exec_ord")))))
    bad = F.filter(pairs, lambda y: y["dep_exec_ord"] > y["task_exec_ord"])
    return p.select("request_id", F.explode(bad).alias("v")).select("request_id", "v.*")


def execution_mode(tasks: DataFrame) -> DataFrame:
    """Parallel only if asked for and no task has a dependency.

    ``tasks`` are task rows; one grouped aggregate, combined before the shuffle.
    """
    per = normalise_tasks(tasks).groupBy("request_id").agg(
        F.count("*").cast("int").alias("n_rows"), F.bool_or(F.size("deps") > 0).alias("has_dependencies"),
        F.bool_and("parallel_requested").alias("parallel"))
    return per.select(
        "request_id", "n_rows", "has_dependencies",
        F.when(F.col("parallel") & ~F.col("has_dependencies"), F.lit("parallel"))
        .otherwise(F.lit("sequential")).alias("mode"))


def unknown_task_types(tasks: DataFrame) -> DataFrame:
    """Tasks whose type is not in the agent registry fail with a message.

    The registry is a fixed three-element list, so this is an ``isin``
    predicate evaluated in the scan's codegen stage (no join).
    """
    bad = ~F.col("task_type").isin(*fixed.TASK_TYPES)
    return tasks.where(bad).select(
        "request_id", "pos", "task_id", "task_type", F.lit("failed").alias("status"),
        F.concat(F.lit(fixed.UNKNOWN_TASK), F.col("task_type")).alias("error"))


def pending_tasks(queue: DataFrame, acks: DataFrame, keys=("request_id", "pos")) -> DataFrame:
    """Queued tasks without an acknowledgement (left-anti join on the keys).

    AQE broadcasts the acknowledgement side only when it is measured small;
    otherwise both sides shuffle on the keys.
    """
    return queue.join(acks.select(*keys).distinct(), on=list(keys), how="left_anti")


def orchestrate(tasks: DataFrame, providers, agents=None, timed: bool = True):
    """Run orchestration requests through the agent job.

    ``tasks`` are task rows with the inputs of their run: code, language,
    error_message, analysis_type, doc_type, style, and session_id (equal within
    a request). Returns ``(results, histories, executions)``: a result row for
    each ordered task in its place, and the history and execution rows of the
    agents' own runs. A task of an unknown type fails with the registry
    message. As in the service a task gets its own inputs only, never another
    task's output, and no failure keeps another task from running: order is the
    order of the results, and all tasks of all requests run in one pass. Times
    are measured; ``timed=False`` gives 0.0, for results that reruns repeat.

    The tasks, their order and the replies are stored, so all rows agree.
    """
    from .inference import INPUT_COLUMNS, agent_job, default_agents

    agents = agents or default_agents()
    tasks = materialize(tasks, "tasks")  # read twice: for the order and for the inputs
    ordered = with_priority_order(plan_requests(tasks)).select(
        "request_id", "n_rows", "parallel_requested", F.explode("exec_tasks").alias("t")).select(
        "request_id", "n_rows", "parallel_requested", "t.exec_ord", "t.pos", "t.task_id", "t.task_type")
    inputs = tasks.select("request_id", F.col("pos").cast("int").alias("pos"), "session_id", *[c for c in INPUT_COLUMNS if c != "agent_type"])
    run = materialize(ordered.join(inputs, ["request_id", "pos"]), "run")
    responses, histories, executions = agent_job(
        run.select(F.struct("request_id", "pos").alias("request_id"), "session_id", F.col("task_type").alias("agent_type"),
                   *[c for c in INPUT_COLUMNS if c != "agent_type"]), providers, agents=agents)
    known = F.coalesce(F.col("task_type").isin(*agents), F.lit(False))
    answered = responses.select(F.col("request_id.request_id").alias("request_id"), F.col("request_id.pos").alias("pos"),
                                "success", "result", "error", "execution_time_ms")
    results = run.join(answered, ["request_id", "pos"]).select(
        "request_id", "session_id", "n_rows", "parallel_requested", "exec_ord", "pos", "task_id", "task_type",
        F.when(F.col("success"), F.lit("completed")).otherwise(F.lit("failed")).alias("status"), "result",
        F.when(known, F.col("error")).otherwise(F.concat(F.lit(fixed.UNKNOWN_TASK), F.coalesce("task_type", F.lit("None")))).alias("error"),
        (F.col("execution_time_ms") if timed else F.lit(0.0)).alias("execution_time_ms"))
    return results, histories, executions


def orchestration_rollup(results: DataFrame) -> DataFrame:
    """Per request totals, overall status and the summary text.

    ``results`` are the rows of ``orchestrate``. ``pseudo_tokens`` is the sum
    of time // 10. One grouped aggregate; the summary takes the results in
    execution order.
    """
    text = F.concat(
        F.lit("### Task "), F.col("exec_ord").cast("string"), F.lit(": "), F.col("task_id"),
        F.lit("\nStatus: "), F.col("status"),
        F.lit("\nTime: "), fixed_digits(F.col("execution_time_ms"), 2), F.lit("ms"),
        F.lit("\nResult:\n"), F.coalesce(F.nullif(F.col("result"), F.lit("")), F.col("error"), F.lit("None")))
    ok = F.col("status") == "completed"
    per = results.groupBy("request_id").agg(
        F.max("n_rows").alias("total_tasks"), F.count_if(ok).cast("int").alias("completed"), F.count_if(F.col("status") == "failed").cast("int").alias("failed"),
        F.bool_and(ok).alias("success"), F.sum("execution_time_ms").alias("total_time_ms"),
        F.sum(F.floor(F.col("execution_time_ms") / 10)).cast("double").alias("pseudo_tokens"),
        F.sort_array(F.collect_list(F.struct("exec_ord", text.alias("text")))).alias("_texts"),
        F.min("session_id").alias("session_id"), F.bool_and("parallel_requested").alias("parallel"))
    return per.select(
        "request_id", "session_id", "parallel", "total_tasks", "completed", "failed", "success",
        F.when(F.col("success"), F.lit("completed")).otherwise(F.lit("partial")).alias("status"),
        "total_time_ms", "pseudo_tokens",
        F.array_join(F.transform("_texts", lambda x: x["text"]), "\n\n").alias("summary"))


def orchestration_log(rollup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One history row and one execution row a request, from C3's rows."""
    count = F.col("total_tasks").cast("string")

    def said(template: str) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), count, F.lit(after))

    history = rollup.select(
        "session_id", said(fixed.ORCHESTRATION_MESSAGE).alias("user_message"), F.col("summary").alias("agent_response"),
        F.lit("orchestrator").alias("agent_type"),
        F.to_json(F.struct("total_tasks", "completed", "failed", "parallel")).alias("metadata_json"))
    executions = rollup.select(
        "session_id", F.lit("orchestrator").alias("agent_type"), said(fixed.ORCHESTRATION_TASK).alias("task_description"), "status",
        F.substring("summary", 1, fixed.RESULT_PREFIX_CHARS).alias("result"), F.col("total_time_ms").alias("execution_time_ms"),
        F.col("pseudo_tokens").cast("bigint").alias("tokens_used"))
    return history, executions
