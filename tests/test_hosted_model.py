import json

from weftline.plans.pipeline import interpret
from weftline.plans.providers import HostedModel
from weftline.sources import graph as G
from weftline.sources import schemas


def test_every_concept_is_sent(spark):
    node = lambda i: (f"n{i:03}", f"name {i}", "Operation", "", [], ["Operation", "Rule"], None)
    nodes, _ = G.memory_graph(spark, [node(i) for i in range(450)], [])

    def call(system, user, n, t):
        seen = [json.loads(x)["context"] for x in user.split("\n")[2:]]
        steps = [{"text": c["id"], "reason": ",".join(c["types"])} for c in seen] + [{"text": "same", "reason": "r"}]
        return "Here: " + json.dumps({"intent": "i", "inferred_steps": steps, "dependencies": [{"before": seen[0]["id"], "after": "same"}]})

    p = spark.createDataFrame([(1, "transfer funds")], "prompt_id int, text string")
    intents, steps, deps = interpret(p, HostedModel(call, "t"), nodes)
    got = [(r.text, r.reason) for r in steps.orderBy("step_index").collect() if not r.explicit]
    assert [x for x in got if x[0] != "same"] == [(f"n{i:03}", "Operation,Rule") for i in range(450)]
    assert len(got) == 451 and intents.first()["intent"] == "i"
    assert [(r.before, r.after) for r in deps.orderBy("seq").collect()] == [("n000", "same"), ("n200", "same"), ("n400", "same")]
