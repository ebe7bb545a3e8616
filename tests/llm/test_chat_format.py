import hashlib
import random

from pyspark.sql import functions as F

from splatspark.llm import chat_format as cf

PARTS = ["\\", "<", "/turn>", "</turn>", "#", "###", "e", "h", "c", ":", " ", "\n", "é", "\U0001f600", "\\e", "### user: "]


def turns():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
    out = [(i % 37, i // 37, rng.choice(["user", "assistant", "system", "a: b", "x###", None]), rng.choice([text(), text(), text(), None])) for i in range(400)]
    return out + [(None, 0, "assistant", "no id"), (5, None, "user", "no turn"), out[7], out[7], (cf.PROBE_ID, 0, "user", cf.PROBE_TEXT), (cf.PROBE_ID, 1, "assistant", cf.PROBE_TEXT)]


def plain(data):
    out = {}
    for conv in {d[0] for d in data}:
        own = sorted((d[1] is not None, d[1] or 0, d[2] or "", d[3] or "") for d in data if d[0] == conv)
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    data = turns()
    got = cf.digests(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(data)
    assert cf.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_folding(spark):
    log = [
        (1, "m1", 1, "open", "user", "Hi"), (1, "m1", 2, "delta", None, " there"),
        (1, "m2", 3, "open", "assistant", None), (1, "m2", 4, "delta", None, "Wrong"), (1, "m2", 5, "regenerate", None, None), (1, "m2", 6, "delta", None, "Ri"), (1, "m2", 7, "delta", None, "ght"),
        (1, "m3", 8, "open", "user", "x"), (1, "m3", 9, "edit", None, "edited"), (1, "m3", 10, "delta", None, "!"),
        (1, "m4", 11, "open", "user", "gone"), (1, "m4", 12, "delete", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, message string, seq bigint, kind string, role string, text string").repartition(5)
    row = cf.rendered(cf.folded(events)).first()
    assert row.formatted == "### user: Hi there</turn>\n### assistant: Right</turn>\n### user: edited!</turn>\n"
    assert [row.formatted[s["at"] : s["at"] + s["length"]] for s in row.loss_spans] == ["Right"]


def test_escapes(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escaped(F.col("t")).alias("e")).withColumn("back", cf.unescaped(F.col("e"))).collect()
    assert all(r.back == r.t and "###" not in r.e and "</turn>" not in r.e for r in rows)
