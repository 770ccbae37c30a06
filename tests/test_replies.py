"""JSON in replies: whole, fenced, broken, nested."""

import json

from pyspark.sql import functions as F

from strandweave.functions import text as T


def test_values_of_replies(spark):
    value = {"verdicts": [{"connected": True, "why": 'a "quoted" } ] brace'}], "n": 2}
    good = json.dumps(value)
    cases = [
        (good, value), (f"```json\n{good}\n```", value), (f"```\n{good}```", value), (f"```JSON{good}", value), (f"Here: {good} - that's it", value), (f"{{no}} {good} {{", value),
        (f"```json\n{{bad\n```\nthen\n```json\n{good}\n```\n{{", value), (f'say "hi {good}', value), ("[1, 2", None), ("", None), (None, None), ("none at all", None), ("[1, [2]] tail", [1, [2]]), ("{} x {1}", {}),
        ('{"a": "\\\\"} {"b": 1,}', {"a": "\\"}), ("}{", None), ("5", 5),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", F.to_json(T.lenient_json(F.col("t"))).alias("j")).collect()}
    assert {i: None if got[i] is None else json.loads(got[i]) for i in got} == {i: want for i, (_, want) in enumerate(cases)}
