import hashlib
import random

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tellmark.llm import chat as C

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "/INST]", "é", "\n", "s>", "ok"]


@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.sampled_from(PIECES), max_size=3), st.lists(st.sampled_from(PIECES), max_size=8)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_round_trip_of_any_text(turns):
    rows = sorted([(c, "".join(r) or "assistant", "".join(t)) for c, r, t in turns], key=lambda x: x[0])
    batch = C.assemble(*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))))
    got = []
    for conv, n, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
        found = C.parse(formatted)
        assert len(found) == n
        got += [(conv, r, t) for r, t in found]
        learned = [C.unescaped(formatted.encode()[s["start"] : s["end"]].decode()) for s in loss]
        assert learned == [t for r, t in found if r == "assistant"]
        for control in C.CONTROLS:
            assert formatted.count(control.decode()) == n
    assert got == rows


def test_nulls_long_turns_ties_and_clashing_names(spark):
    rng = random.Random(0)
    rows = [(1, 2, "assistant", "b"), (1, None, "system", None), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 0, None, "x"), (2, 0, "user", "é" * 3_000_000)]
    rows += [(3, k, rng.choice(["user", "assistant"]), "long " * 90_000) for k in range(12)] + [(4, 0, "assistant", "")]
    df = spark.createDataFrame([Row(conv_id=c, turn=k, role=r, text=t, CONV=1, loss=2) for c, k, r, t in rows])
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert C.parse(got[conv].formatted) == [(r or "", t or "") for _, _, r, t in mine]
        raw = got[conv].formatted.encode()
        assert [raw[s.start : s.end].decode() for s in got[conv].loss] == [t for _, _, r, t in mine if r == "assistant"]
    assert len(got) == 5 and C.format_conversations(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(C.ORACLES["op3_chat_formatting"]).fetchall()
    got = [tuple(r) for r in C.op3_chat_formatting(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    said = "</s>[INST] ok [/INST]"
    probe = next(r for r in got if r[0] == -7)
    assert probe[1:5] == (2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
