"""What the runtimes of languages do when they are called: effects of calls by name, as a rule of the fold.

A model names what it holds for: a whole callee, or a method of anything; a whole callee comes first.
The node's own language must be one of the model's. Models are rows of a small table of fixed size,
joined by broadcast; a deployment can add its own.

Defined cases: calls without a language have no model; in Python a method needs a receiver; an event's
name is known from a literal argument only; positions behind the last argument give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import Graph
from weftgraph.operators.overlays import Delta, Rule, _all, _edges, _id, _nodes, prop
from weftgraph.operators.reach import arguments
from weftgraph.plans.durable import durable

# Names, what calling them does, and where: r the argument that the result derives from, rr whether it
# derives from the receiver, cb the callback's position, ev the event name's position or the name itself, to the destination's.
SCRIPT_CALLEES = (
    ("fetch", "network-request async", {}),
    ("JSON.parse parseInt parseFloat", "parse derives-return", {"r": 0}),
    ("JSON.stringify", "serialize derives-return", {"r": 0}),
    ("String Number Boolean", "coerce derives-return", {"r": 0}),
    ("Buffer.from", "decode-or-copy derives-return", {"r": 0}),
    ("decodeURI decodeURIComponent", "decode derives-return", {"r": 0}),
    ("encodeURI encodeURIComponent", "encode derives-return", {"r": 0}),
    ("setTimeout setInterval setImmediate", "timer registers-callback async", {"cb": 0}),
    ("queueMicrotask", "microtask registers-callback async", {"cb": 0}),
    ("Worker", "worker-spawn async", {}),
    ("readFile fs.readFile", "filesystem-read registers-callback async", {"cb": -1}),
    ("writeFile fs.writeFile", "filesystem-write registers-callback async", {"cb": -1}),
    ("exec", "process-execution registers-callback async", {"cb": -1}),
)
SCRIPT_METHODS = (
    ("get has", "reads-receiver", {}),
    ("set add delete clear push", "mutates-receiver", {}),
    ("pop", "mutates-receiver reads-receiver", {}),
    ("text arrayBuffer", "response-body async derives-return-from-receiver", {"rr": True}),
    ("json", "response-body parse async derives-return-from-receiver", {"rr": True}),
    ("then", "promise-continuation registers-callback async", {"cb": 0}),
    ("catch", "promise-rejection registers-callback async", {"cb": 0}),
    ("finally", "promise-finalizer registers-callback async", {"cb": 0}),
    ("addEventListener on once", "event-registration registers-callback", {"ev": 0, "cb": 1}),
    ("subscribe", "subscription registers-callback async", {"cb": 0}),
    ("consume", "queue-consumer registers-callback async", {"ev": 0, "cb": 1}),
    ("emit dispatchEvent", "emits-event", {"ev": 0}),
    ("publish", "message-publish emits-event async", {"ev": 0}),
    ("send", "message-send async", {}),
    ("postMessage", "worker-message emits-event async", {"ev": "message"}),
    ("pipe", "stream-pipe async", {"to": 0}),
    ("pipeThrough", "stream-transform async", {"to": 0}),
    (
        "at concat normalize padEnd padStart repeat replace replaceAll slice split substring substr toLowerCase toString toUpperCase trim trimEnd trimStart valueOf",
        "derives-return-from-receiver",
        {"rr": True},
    ),
)
PYTHON_CALLEES = (
    ("os.system os.popen subprocess.run subprocess.call subprocess.check_call subprocess.check_output subprocess.Popen", "process-execution", {}),
    ("open", "filesystem-access", {}),
    ("json.loads json.load int float", "parse derives-return", {"r": 0}),
    ("json.dumps", "serialize derives-return", {"r": 0}),
    ("str bytes", "coerce derives-return", {"r": 0}),
    ("eval exec", "dynamic-evaluation", {}),
)
PYTHON_METHODS = (
    ("format join lower upper strip lstrip rstrip replace split splitlines title casefold", "derives-return-from-receiver", {"rr": True}),
    ("encode", "encode derives-return-from-receiver", {"rr": True}),
    ("decode", "decode derives-return-from-receiver", {"rr": True}),
    ("append extend update", "mutates-receiver", {}),
)
MODEL = "model_id string, language string, whole boolean, name string, behaviors array<string>, r int, rr boolean, cb int, ev int, event string, dest int"


def models(spark) -> DataFrame:
    """The models as rows."""
    rows = []
    for model_id, languages, callees, methods in (("generic-runtime-behaviors", ("typescript", "javascript"), SCRIPT_CALLEES, SCRIPT_METHODS), ("python-runtime-behaviors", ("python",), PYTHON_CALLEES, PYTHON_METHODS)):
        for whole, table in ((True, callees), (False, methods)):
            for names, does, at in table:
                ev = at.get("ev")
                for name in names.split():
                    rows += [(model_id, lang, whole, name, does.split(), at.get("r"), at.get("rr", False), at.get("cb"), ev if isinstance(ev, int) else None, ev if isinstance(ev, str) else None, at.get("to")) for lang in languages]
    return spark.createDataFrame(rows, MODEL)


def bound_calls(g: Graph, table: DataFrame | None = None) -> DataFrame:
    """(call_id, model, ...): calls with the model that holds for them, a whole callee before a method."""
    t = F.broadcast(models(g.nodes.sparkSession) if table is None else table)
    python = F.col("language") == "python"
    callee = F.regexp_replace(F.coalesce(prop("callee"), F.lit("")), r"\?\.", ".")
    name = F.coalesce(prop("callee_name"), F.lit(""))
    receiver = F.when(F.coalesce(prop("receiver"), F.lit("")) != "", prop("receiver"))
    whole = F.when(python, F.concat_ws(".", receiver, name)).otherwise(callee)
    method = F.when(python, F.when(receiver.isNotNull(), name)).otherwise(F.coalesce(F.when(prop("method_name") != "", prop("method_name")), F.substring_index(callee, ".", -1)))
    c = g.nodes.filter(F.col("kind").isin(*schema.CALLSITE_KINDS) & F.col("language").isNotNull())
    c = c.select(F.col("id").alias("call_id"), "language", prop("value_id").alias("value_id"), prop("receiver_value_id").alias("receiver_id"), F.explode(F.array(F.struct(F.lit(True).alias("whole"), whole.alias("name")), F.struct(F.lit(False).alias("whole"), method.alias("name")))).alias("x")).select("call_id", "language", "value_id", "receiver_id", "x.*")
    j = c.join(t, ["language", "whole", "name"])
    rest = [x for x in j.columns if x not in ("call_id", "whole")]
    return j.groupBy("call_id").agg(F.min_by(F.struct(*rest, "whole"), F.when(F.col("whole"), 0).otherwise(1)).alias("m")).select("call_id", "m.*").withColumn("model", F.when(F.col("whole"), F.col("name")).otherwise(F.concat(F.lit("*."), "name")))


def runtime_behaviors(g: Graph) -> Delta:
    """An effect per call with a model; what its result derives from, and what it changes."""
    c = F.col
    args = arguments(g).join(g.nodes.select(F.col("id").alias("argument_id"), F.when(F.coalesce(prop("literal"), F.lit("false")).isin("false", "0", ""), None).otherwise(prop("literal_value")).alias("literal")), "argument_id", "left")
    args = args.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(-1)).alias("p"), "argument_id", "literal"))).alias("args"))
    b = bound_calls(g).join(args, "call_id", "left").withColumn("args", F.coalesce("args", F.array().cast("array<struct<p:bigint,argument_id:string,literal:string>>")))
    b = b.withColumn("event_name", F.coalesce("event", F.when(c("ev").isNotNull(), F.get("args", c("ev"))["literal"])))
    b = durable(b.withColumn("effect_id", F.when(c("model_id") == "python-runtime-behaviors", _id("python-runtime-behaviors", "function-effect", c("call_id"), c("model"), owner="runtime-model")).otherwise(_id("generic-runtime-behaviors", "function-effect", c("call_id"), c("model"), owner="runtime-model"))), "runtime")
    ev = [c("call_id"), c("effect_id")]
    nodes = _nodes(b, c("effect_id"), "function-effect", F.concat(F.lit("runtime:"), "model"), [c("call_id")], model_id=c("model_id"), model=c("model"), effect_kind=F.lit("runtime-call"), callsite_id=c("call_id"), behaviors=c("behaviors"), receiver_value_id=c("receiver_id"), callback_argument=c("cb"), destination_argument=c("dest"), event_name=c("event_name"))
    valued = b.filter("value_id is not null")
    edges = _all(
        _edges(b, c("call_id"), c("effect_id"), "APPLIES_EFFECT", ev),
        _edges(b, c("effect_id"), c("call_id"), "EVIDENCED_BY", ev),
        _edges(valued.filter("r is not null").withColumn("argument_id", F.get("args", c("r"))["argument_id"]), c("argument_id"), c("value_id"), "VALUE_FLOWS_TO", ev, "runtime-derived-return"),
        _edges(valued.filter("rr and receiver_id is not null"), c("receiver_id"), c("value_id"), "VALUE_FLOWS_TO", ev, "runtime-derived-return"),
        _edges(b.filter("receiver_id is not null").filter(F.array_contains("behaviors", "mutates-receiver")), c("call_id"), c("receiver_id"), "MUTATES", ev, effect_id=c("effect_id")),
    )
    return Delta(nodes, edges)


RULE = Rule("runtime-behaviors", lambda g: not bound_calls(g).isEmpty(), runtime_behaviors)
