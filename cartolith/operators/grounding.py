"""What a model returns: schema checks, cited ids against the input, and the call itself as an injected function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 3


def schema_error(value, schema: dict, path: str = "$") -> str | None:
    """The first violation of a JSON-schema subset, with its path; None if there is none."""
    kind = schema.get("type")
    types = {"object": dict, "array": list, "string": str, "integer": int}
    if kind and (not isinstance(value, types[kind]) or kind == "integer" and isinstance(value, bool)):
        return f"{path}: expected {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the allowed values"
    limits = {dict: (), str: (("minLength", "maxLength", len),), list: (("minItems", "maxItems", len),), int: (("minimum", "maximum", int),)}
    for low, high, size in limits.get(type(value), ()):
        if schema.get(low) is not None and size(value) < schema[low]:
            return f"{path}: below {low}"
        if schema.get(high) is not None and size(value) > schema[high]:
            return f"{path}: above {high}"
    inner: list[tuple] = []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if missing := [k for k in schema.get("required", ()) if k not in value]:
            return f"{path}: missing {missing[0]}"
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in known]):
            return f"{path}: unexpected {extra[0]}"
        inner = [(value[k], s, f"{path}.{k}") for k, s in known.items() if k in value]
    elif isinstance(value, list):
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            return f"{path}: items repeat"
        inner = [(v, schema.get("items", {}), f"{path}[{i}]") for i, v in enumerate(value)]
    return next((e for e in (schema_error(*x) for x in inner) if e), None)


def validated(text: Column, schema: dict) -> Column:
    """STRUCT<ok, error> of a JSON text."""

    def one(value: str | None) -> dict:
        try:
            error = schema_error(json.loads(value or ""), schema)
        except ValueError:
            error = "$: not JSON"
        return {"ok": error is None, "error": error}

    return F.udf(one, "ok boolean, error string", useArrow=True)(text)


def narrowed(schema: dict, field: str, ids: list[str]) -> dict:
    """The schema with a list field's items limited to the ids of this input."""
    out = json.loads(json.dumps(schema))
    spec = out["properties"][field]
    spec["items"] = spec.get("items", {}) | {"enum": ids}
    spec["maxItems"] = min(spec.get("maxItems", len(ids)), len(ids))
    return out


def validation_rates(checks: DataFrame) -> DataFrame:
    """Verified and invalid by task (task, verified boolean), and all together as task 'all'."""
    ok = F.count_if("verified")
    by = checks.rollup("task").agg(F.grouping("task").alias("_all"), ok.alias("verified"), (F.count("*") - ok).alias("invalid"))
    return by.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("task")).alias("task"), "verified", "invalid", F.bround(F.col("verified") / F.greatest(F.lit(1), F.col("verified") + F.col("invalid")), 6).alias("rate"))


def context_window(characters: Column, output_tokens: int) -> Column:
    """The smallest context of 4096, 8192 and 16384 tokens that holds 0.8 tokens a character, the output and 512; an error beyond."""
    need = F.ceil(characters * 0.8) + output_tokens + 512
    size = F.when(need <= 4096, 4096).when(need <= 8192, 8192).when(need <= 16384, 16384)
    return size.when(need.isNotNull(), F.raise_error(F.concat(F.lit("a prompt needs more than 16384 tokens: "), need.cast("string"))))


def generate(inputs: DataFrame, call: Callable[[str, str], dict], schema: dict) -> DataFrame:
    """(doc_id, task, response, error, attempts) of inputs (doc_id, task, prompt): up to ATTEMPTS calls each.

    A failure is a row, never an exception, so one bad answer costs no other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, task, prompt in zip(batch["doc_id"], batch["task"], batch["prompt"]):
                answer, error, n = None, "no attempt", 0
                while error and n < ATTEMPTS:
                    n += 1
                    try:
                        answer = call(task, prompt)
                        error = schema_error(answer, schema)
                    except Exception as e:  # noqa: BLE001  whatever the model client raises belongs to this row
                        error = f"{type(e).__name__}: {e}"
                out.append((doc, task, None if error else json.dumps(answer, ensure_ascii=False, sort_keys=True), error, n))
            yield pd.DataFrame(out, columns=["doc_id", "task", "response", "error", "attempts"])

    return inputs.select("doc_id", "task", "prompt").mapInPandas(run, "doc_id long, task string, response string, error string, attempts int")


def embed(rows: DataFrame, text_col: str, call: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """rows with `vector`, the texts sent in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.fillna("").tolist()))

    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text_col)))
