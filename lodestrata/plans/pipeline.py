"""Pipelines: rule lists, step graphs and manifests, compiled to one lazy DataFrame a node."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import OPERATORS, apply
from ..operators.layer import GEOM, ROW, st_valid


class SpecError(ValueError):
    pass


@dataclass
class Step:
    id: str
    kind: str
    operator: str = ""
    params: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    refs: dict = field(default_factory=dict)  # parameter -> layer name, or list of them
    when: dict | None = None
    more: dict = field(default_factory=dict)


#: Parameters that hold layers.
LAYER_PARAMS = ("ref_gdf", "ref_gdfs", "mask_gdf", "network_gdf", "hubs_gdf", "destinations_gdf", "road_network", "reference_gdf")


def load(spec) -> list[Step]:
    """A rule list, {"steps": [...]}, JSON text of either, or steps themselves."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    if isinstance(spec, list) and all(isinstance(s, Step) for s in spec):
        return spec
    return _rules(spec) if isinstance(spec, list) else _graph(spec)


def _rules(rules: list[dict]) -> list[Step]:
    """Version 1: rules {capability, config, enabled?, order?}, run one after the other in order."""
    live = [r for r in rules if r.get("enabled", True)]
    live.sort(key=lambda r: (r.get("config") or {}).get("order", r.get("order", 0)))
    out: list[Step] = []
    for i, r in enumerate(live):
        params = {k: v for k, v in (r.get("config") or r.get("params") or {}).items() if k != "order"}
        out.append(_step({"id": r.get("id", f"rule{i}"), "capability": r.get("capability") or r.get("operator"), "params": params, "ref_layer": params.pop("ref_layer", r.get("ref_layer")), "input": [out[-1].id] if out else ["input"]}))
    return out


def _graph(spec: dict) -> list[Step]:
    """Version 2: steps {id, type?, capability, params, input?, ref_layer?, when?}; without input a step follows the one before."""
    out: list[Step] = []
    for i, s in enumerate(spec.get("steps", [])):
        s = dict(s)
        s.setdefault("id", f"step{i}")
        inputs = s.get("input", s.get("inputs"))
        s["input"] = [inputs] if isinstance(inputs, str) else list(inputs) if inputs else [out[-1].id if out else "input"]
        out.append(_step(s))
    return out


def _step(s: dict) -> Step:
    kind = s.get("type", "capability")
    params = {k: v for k, v in (s.get("params") or {}).items()}
    if s.get("capability") == "calculate" and "expression" in params:
        params = {"expressions": {params.get("output_field", "result"): params["expression"]}}
    refs = {}
    for k in [k for k in params if k in LAYER_PARAMS]:
        refs[k] = params.pop(k)
    if ref := s.get("ref_layer") or s.get("with"):
        accepted = OPERATORS[s["capability"]].params if s.get("capability") in OPERATORS else {}
        name = next((p for p in LAYER_PARAMS if p in accepted), "ref_gdf")
        refs[name] = [ref] if name == "ref_gdfs" and isinstance(ref, str) else ref
    return Step(s["id"], kind, s.get("capability") or s.get("operator") or "", params, s.get("input", []), refs, s.get("when"), {k: v for k, v in s.items() if k in ("condition", "body", "items", "variable")})


def order(steps: list[Step], known: set[str]) -> list[Step]:
    """Steps so that each comes after what it reads."""
    by = {s.id: s for s in steps}
    if len(by) < len(steps):
        raise SpecError("two steps have one id")
    done: list[Step] = []
    state: dict[str, int] = {}

    def visit(s: Step) -> None:
        if state.get(s.id) == 2:
            return
        if state.get(s.id) == 1:
            raise SpecError(f"{s.id} depends on itself")
        state[s.id] = 1
        for name in _reads(s):
            if name in by:
                visit(by[name])
            elif name not in known:
                raise SpecError(f"{s.id} reads {name}, which is neither a step nor an input")
        state[s.id] = 2
        done.append(s)

    for s in steps:
        visit(s)
    return done


def _reads(s: Step) -> list[str]:
    refs = [n for r in s.refs.values() for n in (r if isinstance(r, list) else [r])]
    return [*s.inputs, *[r for r in refs if isinstance(r, str)]]


def validate(spec, inputs=("input",)) -> list[str]:
    """What is wrong with a pipeline; nothing if it can run."""
    try:
        steps = load(spec)
        order(steps, set(inputs))
    except (SpecError, KeyError, json.JSONDecodeError) as e:
        return [str(e)]
    out = []
    for s in steps:
        if s.kind in ("capability", "rule"):
            if s.operator not in OPERATORS:
                out.append(f"{s.id}: no operator {s.operator}")
            elif bad := set(s.params) - set(OPERATORS[s.operator].params):
                out.append(f"{s.id}: {s.operator} has no parameter {', '.join(sorted(bad))}")
    return out


def _filled(value, values: dict):
    """$name in parameters replaced."""
    if isinstance(value, str) and value.startswith("$") and value[1:] in values:
        return values[value[1:]]
    if isinstance(value, dict):
        return {k: _filled(v, values) for k, v in value.items()}
    return [_filled(v, values) for v in value] if isinstance(value, list) else value


def _holds(df: DataFrame, when: dict) -> bool:
    """Whether any row fulfils the condition: one small action."""
    return not df.where(E.predicate_column(df, when)).limit(1).isEmpty()


def run(spec, inputs: dict[str, DataFrame] | DataFrame, values: dict | None = None, each: dict[str, DataFrame] | None = None) -> DataFrame:
    """The last step's DataFrame. `inputs` are layers by name (one alone is "input"); `each` receives every step's."""
    layers = dict(inputs) if isinstance(inputs, dict) else {"input": inputs}
    if "input" not in layers and layers:
        layers["input"] = next(iter(layers.values()))
    steps = load(spec)
    for s in order(steps, set(layers)):
        src = [layers[n] for n in s.inputs]
        layers[s.id] = _NODES.get(s.kind, _capability)(s, src, layers, values or {})
        if each is not None:
            each[s.id] = layers[s.id]
    return layers[steps[-1].id] if steps else layers["input"]


def _capability(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    df = src[0]
    if s.when and not _holds(df, _filled(s.when, values)):
        return df
    params = _filled(s.params, values)
    for k, r in s.refs.items():
        got = [layers[n] if isinstance(n, str) else n for n in (r if isinstance(r, list) else [r])]
        params[k] = got if k == "ref_gdfs" else got[0]
    return apply(s.operator, df, **params)


def _branch(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    c = _filled(s.more.get("condition") or s.params, values)
    return src[0].where(E.attribute_column(src[0], c.get("field") or c.get("attr"), c.get("op", "eq"), c.get("value")))


def _loop(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    """The body for each item, its name filled in; results one after the other."""
    items = _filled(s.more.get("items") or s.params.get("items") or [], values)
    name = s.more.get("variable") or s.params.get("variable") or "item"
    outs = [run({"steps": s.more.get("body") or s.params.get("body")}, layers | {"input": src[0]}, values | {name: x}) for x in items]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs) if outs else src[0].limit(0)


def _together(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), src)


def _parallel(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    """Branches {steps} of one input, put together in the order written (Spark runs them at once)."""
    outs = [run({"steps": b["steps"] if isinstance(b, dict) else b}, layers | {"input": src[0]}, values) for b in s.more.get("body") or s.params.get("branches") or []]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs) if outs else src[0]


def _pass(s: Step, src: list[DataFrame], layers: dict, values: dict) -> DataFrame:
    return src[0]


_NODES: dict[str, Callable] = {"capability": _capability, "rule": _capability, "branch": _branch, "loop": _loop, "aggregate": _together, "parallel": _parallel, "dataset": _pass, "artifact": _pass, "trigger": _pass}


def scenarios(specs: list, inputs, mode: str = "sequential") -> list[dict]:
    """Several pipelines: sequential (each gets the one before's result; stops at a failure) or independent."""
    out, cur = [], inputs
    for i, spec in enumerate(specs):
        try:
            df = run(spec, cur if mode == "sequential" else inputs)
            df.schema  # noqa: B018  analysed now, so that errors show here
            out.append({"index": i, "status": "ok", "result": df})
            cur = df
        except Exception as e:  # noqa: BLE001  reported to the caller
            out.append({"index": i, "status": "failed", "error": str(e)})
            if mode == "sequential":
                break
    return out


# ---------------------------------------------------------------- manifests


def run_manifest(spark: SparkSession, manifest: dict, sources: dict[str, DataFrame] | None = None, warehouse: str | None = None) -> dict[str, DataFrame]:
    """Version 3: {sources: {name: {path, ...}}, models: {name: {from, transform: [...], with?, materialize?, assert?}}}.

    Models are views unless `materialize` is table (written and read back) or incremental (new keys appended to what is there;
    `key` names the column). A failed assertion of severity error raises, after the model is stored.
    """
    from ..sources.vector import read_vector

    layers = dict(sources or {})
    for name, s in (manifest.get("sources") or {}).items():
        if name not in layers:
            layers[name] = read_vector(spark, s["path"], **{k: v for k, v in s.items() if k not in ("path", "type")})
    models = manifest.get("models") or {}
    if isinstance(models, list):
        models = {m["name"]: m for m in models}
    fake = [Step(n, "capability", inputs=[m["from"]] if isinstance(m.get("from"), str) else list(m.get("from") or []), refs={"ref_gdf": r} if (r := m.get("with")) else {}) for n, m in models.items()]
    for s in order(fake, set(layers)):
        m = models[s.id]
        src = layers[s.inputs[0]]
        steps = [dict(t) | ({"ref_layer": m["with"]} if m.get("with") and "ref_layer" not in t and any(p in LAYER_PARAMS for p in OPERATORS[t["capability"]].params) else {}) for t in m.get("transform") or []]
        df = run({"steps": steps}, layers | {"input": src}) if steps else src
        how = str(m.get("materialize", "view")).lower()
        if how == "view":
            df.createOrReplaceTempView(s.id)
        else:
            path = f"{(warehouse or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{s.id}"
            if how == "incremental":
                try:
                    old = spark.read.parquet(path)
                    df = df.join(old.select(m["key"]), m["key"], "left_anti")
                except Exception as e:  # noqa: BLE001
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
                df.write.mode("append").parquet(path)
            else:
                df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
        layers[s.id] = df
        failed = check(df, m.get("assert") or m.get("assertions") or [])
        if bad := [f for f in failed if f["severity"] == "error"]:
            raise AssertionError(f"{s.id}: " + "; ".join(f"{f['rule']} failed for {f['count']} rows" for f in bad))
    return {n: layers[n] for n in models}


def check(df: DataFrame, assertions: list[dict]) -> list[dict]:
    """Those that fail, of not_null {column}, unique {column}, geometry_valid, expect_rows {min?, max?}: rule, severity, count."""
    out = []
    simple = [(i, a) for i, a in enumerate(assertions) if (a.get("type") or a.get("rule")) != "unique"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in simple:
        kind = a.get("type") or a.get("rule")
        if kind == "not_null":
            aggs.append(F.count_if(F.col(a["column"]).isNull()).alias(f"c{i}"))
        elif kind == "geometry_valid":
            aggs.append(F.count_if(F.coalesce(~st_valid(GEOM), F.lit(False))).alias(f"c{i}"))
        elif kind != "expect_rows":
            raise SpecError(f"unknown assertion {kind}")
    row = df.agg(*aggs).first()
    for i, a in enumerate(assertions):
        kind = a.get("type") or a.get("rule")
        if kind == "unique":
            cols = a["column"] if isinstance(a["column"], list) else [a["column"]]
            n = df.groupBy(*cols).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        elif kind == "expect_rows":
            n = int(not a.get("min", 0) <= row["n"] <= a.get("max", row["n"]))
        else:
            n = row[f"c{i}"]
        if n:
            out.append({"rule": kind, "severity": a.get("severity", "error"), "count": n})
    return out


def explain(spec, inputs, mode: str = "formatted") -> dict[str, str]:
    """Each step's physical plan."""
    each: dict[str, DataFrame] = {}
    run(spec, inputs, each=each)
    return {k: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode) for k, df in each.items()}


__all__ = ["ROW"]
