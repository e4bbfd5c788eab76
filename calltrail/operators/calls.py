"""Call pairing and trees.

C1  An EXIT closes the latest open ENTER with the same class and method in
    the same scope; other open calls stay open.  Each (scope, class, method)
    key therefore has its own stack.  With ``bal`` the running
    ENTER(+1)/EXIT(-1) balance of a key in ``seq`` order, an ENTER at
    balance ``v`` is closed by the first later EXIT that brings the balance
    back to ``v - 1``.  Put ENTERs under level ``v = bal`` and EXITs under
    ``v = bal + 1``: inside one (key, v) group, ordered by seq, a closed
    ENTER's next row is its EXIT.  The balance comes from a chunked scan
    (``calltrail.operators.scan``), so a hot key is spread over many tasks and
    no Python runs.  Calls that begin and end in one chunk are paired where the
    scan left them; only the ends of calls that cross a chunk border are
    shuffled again.
C2  from the balance alone: an ENTER is never closed if no later balance
    falls below its own, an EXIT is an orphan if it takes the balance below the
    lowest one before it (or below zero).
C3  scopes: thread id, one class-wide stack, manufacturer, device label
    (plus session and device id as options).
C4-C6 group tree rows: scope node, component node (first-seen order in the
    scope), then calls and leaves; sort keys instead of a recursive walk.
C7  the grouped table projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.functions.render import (component_type, date_text, detail, device_group_label,
                                        extra_map, source_ref, time_text)
from calltrail.operators.scan import DEFAULT_CHUNK_SPAN, running_balance

SCOPES = ("thread", "class", "manufacturer", "device", "session", "device_id")
UNKNOWN = "(unknown)"
KEY = ["scope", "class_name", "method"]


def scope_column(scope: str) -> Column:
    """The scope key (non-null string)."""
    if scope == "thread":
        return F.coalesce(F.col("thread_id"), F.lit(0)).cast("string")
    if scope == "class":
        return F.lit("")
    if scope == "manufacturer":
        m = F.coalesce(F.col("device_manufacturer"), F.lit(""))
        return F.when(m == "", F.lit(UNKNOWN)).otherwise(m)
    if scope == "device":
        return device_group_label()
    if scope == "session":
        return F.coalesce(F.col("session_id"), F.lit(UNKNOWN))
    if scope == "device_id":
        return F.coalesce(F.col("device_id"), F.lit(UNKNOWN))
    raise ValueError(f"unknown scope {scope!r}; one of {SCOPES}")


def _exit_duration_text() -> Column:
    # extra["durationMs"] of an event: the column when set, else a param of that name.
    return F.coalesce(F.col("duration_ms").cast("string"), F.col("params").getItem("durationMs"))


def _is_call() -> Column:
    return F.col("type").isin("ENTER", "EXIT")


def _keyed(df: DataFrame, scope: str) -> dict:
    return {"scope": scope_column(scope), "class_name": F.coalesce(F.col("class_name"), F.lit("")),
            "method": F.coalesce(F.col("method"), F.lit(""))}


def balanced_calls(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """The ENTER / EXIT rows, only the columns that pairing needs (key, ``seq``,
    ``type``, ``ts``, ``reported`` = the duration as text), with ``bal``,
    ``depth`` (1 = outermost open call of the key), ``open`` (ENTER never closed)
    and ``orphan`` (EXIT closing nothing).  One exchange of rows."""
    reported = _exit_duration_text() if "params" in df.columns else F.col("duration_ms").cast("string")
    step = F.when(F.col("type") == "ENTER", F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    narrow = df.where(_is_call()).select(*[c.alias(n) for n, c in _keyed(df, scope).items()],
                                         "seq", "type", "ts", reported.alias("reported"), step.alias("__step"))
    b = running_balance(narrow, KEY, "seq", "__step", chunk_span)
    enter = F.col("type") == "ENTER"
    return b.withColumns({
        "depth": (F.col("bal") - F.col("floor") + F.when(enter, 0).otherwise(1)).cast("bigint"),
        "open": enter & F.coalesce(F.col("later_min") >= F.col("bal"), F.lit(True)),
        "orphan": ~enter & (F.col("bal") < F.col("floor")),
    }).drop("__step", "floor", "later_min")


def label_calls(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """The rows of ``balanced_calls`` with

    ``partner_seq`` (the EXIT of an ENTER, the ENTER of an EXIT), ``exit_ts`` and
    ``exit_duration`` (of paired ENTERs, from their EXIT).
    """
    enter = F.col("type") == "ENTER"
    b = balanced_calls(df, scope, chunk_span).withColumn(
        "__v", F.when(enter, F.col("bal")).otherwise(F.col("bal") + 1))
    row = F.struct("seq", "ts", "reported")

    def beside(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("seq")
        return d.withColumns({"__next": F.lead(row).over(w), "__prev": F.lag("seq").over(w)})

    closed, matched = enter & ~F.col("open"), ~enter & ~F.col("orphan")
    near = beside(b, [*KEY, "__chunk", "__v"])
    crosses = (closed & F.col("__next").isNull()) | (matched & F.col("__prev").isNull())
    far = beside(near.where(crosses).drop("__next", "__prev"), [*KEY, "__v"])
    both = near.where(~crosses).unionByName(far)
    return both.withColumns({
        "partner_seq": F.when(closed, F.col("__next.seq")).when(matched, F.col("__prev")),
        "exit_ts": F.when(closed, F.col("__next.ts")),
        "exit_duration": F.when(closed, F.col("__next.reported")),
    }).drop("__next", "__prev", "__v", "__chunk", "reported")


def pair_calls(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """C1 + C3: one row per ENTER with its EXIT (null when still open)."""
    lab = label_calls(df, scope, chunk_span)
    return (lab.where(F.col("type") == "ENTER")
               .select("scope", "class_name", "method", F.col("seq").alias("enter_seq"),
                       F.col("partner_seq").alias("exit_seq"), "depth",
                       F.col("ts").alias("enter_ts"), "exit_ts",
                       F.col("exit_duration").try_cast("bigint").alias("duration_ms")))


def open_calls(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """ENTERs never closed (Android throws emit no EXIT)."""
    b = balanced_calls(df, scope, chunk_span)
    return b.where(F.col("open")).select("scope", "class_name", "method", "seq", "ts", "depth")


def orphan_exits(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """EXITs with no open ENTER of the same method in the scope."""
    b = balanced_calls(df, scope, chunk_span)
    return b.where(F.col("orphan")).select("scope", "class_name", "method", "seq", "ts")


def call_durations(df: DataFrame, scope: str = "thread", chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Per method: calls, closed and open ones, total / max reported duration.

    Every EXIT that is no orphan closes one call of its method, so the balance
    says it all and no EXIT has to meet its ENTER."""
    enter = F.col("type") == "ENTER"
    took = F.when(~enter & ~F.col("orphan"), F.col("reported").try_cast("bigint"))
    per = (balanced_calls(df, scope, chunk_span).groupBy("class_name", "method")
           .agg(F.count_if(enter).cast("bigint").alias("calls"),
                F.count_if(~enter & ~F.col("orphan")).cast("bigint").alias("closed"),
                F.sum(took).cast("bigint").alias("total_ms"), F.max(took).cast("bigint").alias("max_ms")))
    return per.where(F.col("calls") > 0).select(
        "class_name", "method", "calls", "closed", (F.col("calls") - F.col("closed")).alias("open"),
        "total_ms", "max_ms")


def _scope_label(scope: str, first: Column) -> Column:
    if scope == "thread":
        return F.concat(F.lit("Thread: "), first["thread_name"], F.lit(" ["),
                        first["thread_id"].cast("string"), F.lit("]"))
    if scope == "manufacturer":
        return F.concat(F.lit("Manufacturer: "), F.col("scope"))
    if scope == "device":
        return F.concat(F.lit("Device: "), F.col("scope"))
    if scope == "session":
        return F.concat(F.lit("Session: "), F.col("scope"))
    if scope == "device_id":
        return F.concat(F.lit("Device id: "), F.col("scope"))
    return F.lit("")


# What the grouped table shows of an event.
_SHOWN = ["seq", "type", "class_name", "method", "file", "line", "ts", "thread_id", "thread_name",
          "device_manufacturer", "device_model", "tag", "params", "result", "duration_ms", "exception",
          "message", "try_start_line", "condition_result"]


def tree_rows(df: DataFrame, scope: str = "thread", collapsed_scopes=(), collapsed_components=(),
              zone: str = "UTC", chunk_span: int = DEFAULT_CHUNK_SPAN,
              table: bool = False) -> DataFrame:
    """C4-C6 (C7 with ``table``): the group tree flattened in pre-order.

    Rows: scope nodes (``level`` 0; none for the class scope), component
    nodes (``level`` 1, first-seen order inside the scope), then calls (an
    ENTER, absorbing its EXIT) and leaves (CATCH, BRANCH, orphan EXIT) at
    ``level`` 2, in seq order.  Sort by ``(sf, cf, level, seq)``; ``depth``
    is the indent.  ``collapsed_scopes`` / ``collapsed_components`` (pairs
    ``(scope, class_name)``) hide the children of those nodes.
    """
    # Only ENTER and EXIT rows go through the pairing, and only its narrow
    # columns; CATCH and BRANCH rows are leaves as they are.
    lab = label_calls(df, scope, chunk_span).where((F.col("type") == "ENTER") | F.col("orphan"))
    leaves = df.where(~_is_call()).withColumns({
        **_keyed(df, scope), "partner_seq": F.lit(None).cast("bigint"), "exit_duration": F.lit(None).cast("string")})
    paired = ["seq", "scope", "partner_seq", "exit_duration"]
    if table:
        # the display columns of calls meet their pairs once, by seq
        shown = [c for c in _SHOWN if c in df.columns]
        calls = df.where(_is_call()).withColumns(_keyed(df, scope)).select(*shown).join(lab.select(*paired), "seq")
        kept = calls.unionByName(leaves.select(*shown, *paired[1:]))
    else:
        cols = [*paired, "class_name", "method", "type", "ts"]
        kept = lab.select(*cols).unionByName(leaves.select(*cols))
    # Group nodes need only the raw events: partial aggregates straight from
    # the input, so the pairing plan is not re-run for them.
    src = df.withColumns({"scope": scope_column(scope),
                          "class_name": F.coalesce(F.col("class_name"), F.lit(""))})
    first = F.min_by(F.struct("ts", "thread_name", "thread_id"), F.col("seq"))
    scopes = src.groupBy("scope").agg(F.min("seq").alias("sf"), first.alias("__first"))
    comps = src.groupBy("scope", "class_name").agg(F.min("seq").alias("cf"),
                                                   F.min_by("ts", F.col("seq")).alias("start_ts"))
    comps = comps.join(scopes.select("scope", "sf"), "scope")
    top = 0 if scope != "class" else -1

    call_label = F.concat(F.col("class_name"), F.lit("."), F.col("method"),
                          F.coalesce(F.concat(F.lit(" ["), F.col("exit_duration"), F.lit("ms]")),
                                     F.lit("")))
    leaf_label = F.concat(F.col("type"), F.lit(": "), F.col("class_name"), F.lit("."), F.col("method"))
    ev = kept.join(comps.select("scope", "class_name", "sf", "cf"), ["scope", "class_name"])
    is_call = F.col("type") == "ENTER"
    ev_cols = {
        "level": F.lit(2), "depth": F.lit(2 + top),
        "kind": F.when(is_call, F.lit("call")).otherwise(F.lit("leaf")),
        "label": F.when(is_call, call_label).otherwise(leaf_label),
        "start_ts": F.col("ts"),
    }
    events = ev.withColumns(ev_cols)
    comp_rows = comps.select(
        "scope", "class_name", "sf", "cf", F.lit(1).alias("level"), F.lit(1 + top).alias("depth"),
        F.lit("component").alias("kind"),
        F.concat(component_type(), F.lit(": "), F.col("class_name")).alias("label"),
        "start_ts", F.lit(-1).cast("bigint").alias("seq"))
    node_cols = ["scope", "class_name", "sf", "cf", "level", "depth", "kind", "label", "start_ts", "seq"]
    parts = [comp_rows]
    if scope != "class":
        scope_rows = scopes.select(
            "scope", F.lit(None).cast("string").alias("class_name"), "sf",
            F.lit(-1).cast("bigint").alias("cf"), F.lit(0).alias("level"), F.lit(0).alias("depth"),
            F.lit("scope").alias("kind"), _scope_label(scope, F.col("__first")).alias("label"),
            F.col("__first.ts").alias("start_ts"), F.lit(-1).cast("bigint").alias("seq"))
        parts.append(scope_rows)
    if table:
        extra = extra_map()
        ev_table = {
            "date": date_text("ts", zone), "time": time_text("ts", zone), "type_label": F.col("type"),
            "file_line": source_ref(), "manufacturer": F.col("device_manufacturer"),
            "device": F.col("device_model"), "tag_text": F.col("tag"), "detail": detail(extra),
            "nav_seq": F.coalesce(F.col("partner_seq"), F.col("seq")),
        }
        events = events.withColumns(ev_table)
        blank = {k: F.lit("") for k in ev_table if k != "nav_seq"}
        blank["nav_seq"] = F.lit(None).cast("bigint")
        parts = [p.withColumns(blank) for p in parts]
        node_cols = node_cols + list(ev_table)
    rows = events.select(*node_cols)
    for p in parts:
        rows = rows.unionByName(p.select(*node_cols))
    hide = None
    if collapsed_scopes:
        hide = (F.col("level") > 0) & F.col("scope").isin(list(collapsed_scopes))
    if collapsed_components:
        pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"))
                          for s, c in collapsed_components])
        h2 = (F.col("level") == 2) & F.array_contains(
            pairs, F.struct(F.col("scope").alias("s"), F.col("class_name").alias("c")))
        hide = h2 if hide is None else (hide | h2)
    if hide is not None:
        rows = rows.where(~hide)
    return rows


def grouped_table(df: DataFrame, scope: str = "thread", zone: str = "UTC",
                  chunk_span: int = DEFAULT_CHUNK_SPAN, **kw) -> DataFrame:
    """The 9-column grouped table (label, date, time, type, file:line,
    manufacturer, device, tag, detail) plus sort keys and ``nav_seq``."""
    rows = tree_rows(df, scope, zone=zone, chunk_span=chunk_span, table=True, **kw)
    return rows.withColumnsRenamed({"type_label": "type", "tag_text": "tag"})


def window_of_rows(rows: DataFrame, offset: int, limit: int, chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Rows ``offset`` to ``offset + limit - 1`` of the pre-order of tree
    rows (``tree_rows``, ``grouped_table``), with their place ``pos`` (from 0), without sorting the tree.

    Rows are counted per node and stretch of ``seq``; prefix sums of those counts say
    at which place each stretch begins.  The totals of stretches of scopes (one number per
    ``chunk_span`` of seq) are summed on the driver, the rest in windows per stretch and scope.
    Only the rows of stretches that reach into the window are then ranked and kept.  A scope
    without its own row and collapsed nodes are counted as they are: by the rows there.
    """
    cut = rows.withColumn("__chunk", F.floor(F.col("seq") / F.lit(int(chunk_span))).cast("bigint"))
    node = ["sf", "cf", "level", "__chunk"]
    counts = cut.groupBy(*node).agg(F.count(F.lit(1)).cast("bigint").alias("__n"))
    per_scope = (counts.groupBy("sf").agg(F.sum("__n").cast("bigint").alias("__scope"))
                 .withColumn("__far", F.floor(F.col("sf") / F.lit(int(chunk_span))).cast("bigint")))
    near, done = [], 0
    for far, n in sorted(map(tuple, per_scope.groupBy("__far").agg(F.sum("__scope")).collect())):
        if done < offset + limit and done + n > offset:  # at most `limit` of them
            near.append((far, done))
        done += n
    upto = F.sum("__scope").over(Window.partitionBy("__far").orderBy("sf").rowsBetween(Window.unboundedPreceding, 0))
    scopes = (per_scope.withColumn("__own", upto)
              .join(rows.sparkSession.createDataFrame(near, "__far long, __done long"), "__far")
              .select("sf", "__scope", (F.col("__done") + F.col("__own")).alias("__upto")))
    before = Window.partitionBy("sf").orderBy("cf", "level", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("__in", F.coalesce(F.sum("__n").over(before), F.lit(0)))
              .join(scopes, "sf").withColumn("__start", F.col("__upto") - F.col("__scope") + F.col("__in"))
              .where((F.col("__start") < F.lit(offset + limit)) & (F.col("__start") + F.col("__n") > F.lit(offset)))
              .select(*node, "__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy(*node).orderBy("seq")) - 1
    return (cut.join(starts, node).withColumn("pos", place.cast("bigint"))
            .where((F.col("pos") >= F.lit(offset)) & (F.col("pos") < F.lit(offset + limit))).select(*rows.columns, "pos"))
