import hashlib
import random
import re
import time

from pyspark.sql import Row

from tellmark.llm.private import find_private, op8_private_data, score, spans_text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_of_odd_texts_match_python(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "_x@d.e-f.g", "@", ".", "é", "1.2.3.4", "256.1.1.1", "0255.01.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (456) 555-2186", "+", " ", "-", "12", "7", "\n", "%", "x", "😀", "(", "5555555555554444"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a" * 60000 + "@", "1" * 60000, "1." * 30000, "a@" + "b." * 20000 + "c", "+1" + " " * 60000, "9 " * 30000]
    df = spark.createDataFrame([Row(doc_id=i, text=t, H=1, base="x") for i, t in enumerate(texts)])
    got = {r[0]: r[1] for r in find_private(df).select("doc_id", spans_text(F.col("base"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == ",".join(base(t)), repr(t)[:200]


def test_thousands_of_matches_in_one_text(spark):
    """Time follows the length of a text, not the square of its matches; places behind many chunks are right."""
    rng = random.Random(2)
    value = lambda i: rng.choice([f"10.{i % 250}.{i // 250}.7", f"u{i}@h.org", "+49 151 1234567", "4111 1111 1111 1111", "0151/123456", "wort", "é😀", "no(at)where.org"])
    texts = ["word other thing " * 5000, " ".join(f"10.{i % 250}.{i // 250}.7" for i in range(8000)), " ".join(value(i) for i in range(3000))]
    took = []
    for text in texts:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        for _ in range(2):
            began = time.perf_counter()
            rows = find_private(df).select(spans_text(F.col("base")).alias("b"), "base", "added").collect()
            last = time.perf_counter() - began
        took.append(last)
        assert rows[0].b == ",".join(base(text))
        assert not any(a.start < b.end and b.start < a.end for a in rows[0].added for b in rows[0].base)
    print(took)
    assert took[1] < took[0] + 6


def test_query_keeps_base_spans_and_leaves_plain_words_alone(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_private_data(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        for added in set(spans) - set(want):
            _, a, b = added.split(":")
            assert re.search("[0-9@]", docs[r.doc_id][int(a) : int(b)])


def test_learned_contexts_find_unseen_identifiers(spark):
    texts = [f"Please write. Contact mail: user{k}@host{k}.org today" for k in range(6)]
    texts += ["Please write. Contact mail: user9(at)host900123.org today", "Contact mail: \"odd_77123456\", thanks", "in the 123456789 years"]
    texts += [f"words in the a{k}@b.cd of" for k in range(3)] + ["in the end in the sun in the sea " * 5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.added]) for r in find_private(df).collect() if r.added), key=str)
    at = texts[7].index("odd")
    assert got == sorted([(6, [(0, 28, 51)]), (7, [(0, at, at + 12)]), (7, [(0, at, at + 12)]), (None, [(0, at, at + 12)])], key=str)
    assert find_private(df.limit(0)).count() == 0


def added(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in find_private(df).collect() if r.added}


def test_instances_become_seeds_of_further_contexts(spark):
    texts = [f"Contact mail: user{k}@host{k}.org today" for k in range(8)]
    hidden = [f"name{k}(at)host.org" for k in range(4)]
    texts += [f"Contact mail: {x} today" for x in hidden] + [f"Kindly reach {x} instead" for x in hidden]
    texts += ["Kindly reach odd (at) place.net instead"]
    assert added(spark, texts) == {8 + k: [hidden[k % 4]] for k in range(8)} | {16: ["odd (at) place.net"]}


def test_contexts_behind_marks_and_long_words_and_all_shapes(spark):
    long = "w" * 150
    texts = [f"the {long} <mailto:user{k}@host{k}.org> today" for k in range(6)] + [f"the {long} someone [at] host.org today"]
    texts += [f"my phone Tel:+4915112345{k:02} ok" for k in range(6)] + ["my phone 0151 234 567 ok"]
    texts += [f"server address: 10.0.0.{k} up" for k in range(6)] + ["server address: 10-0-0-7 up"]
    assert added(spark, texts) == {6: ["someone [at] host.org"], 13: ["0151 234 567"], 20: ["10-0-0-7"]}


def test_words_around_and_digits_make_patterns(spark):
    texts = [f"case {k}77 from user{k}@host{k}.org wrote {'abcdef'[k]}" for k in range(6)]
    texts += ["see xy from odd_name(at)host.org wrote so", "case 123 from other@@host again"]
    assert added(spark, texts) == {6: ["odd_name(at)host.org"], 7: ["other@@host"]}


def test_hidden_seeds_are_found_again(spark):
    """Half of the known identifiers are spoiled so that no base pattern sees them; contexts must find them and nothing else."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    lead = {"email": "reach me", "phone": "call us", "ip": "server at"}
    texts, hidden = [], {}
    for d in range(240):
        filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
        kind = rng.choice(list(lead))
        known, spoiled = {
            "email": (f"u{d}@h{d}.org", f"u{d}(at)h{d}.org"),
            "phone": (f"+49 151 {d + 1000} 99", f"0151/{d + 100000}"),
            "ip": (f"10.0.{d}.9", f"10-0-{d}-9"),
        }[kind]
        value = spoiled if d % 2 else known
        front = filler(rng.randint(3, 20))
        texts.append(f"{front} {lead[kind] if rng.random() < 0.9 else filler(2)} {value} {filler(5)} {rng.randrange(10**6, 10**7)} {filler(3)}")
        if d % 2:
            hidden[d] = value
    got = added(spark, texts)
    right = sum(got.get(d) == [v] for d, v in hidden.items())
    wrong = sum(len(v) for d, v in got.items()) - right
    print("recall", right / len(hidden), "wrong", wrong, "of", right + wrong)
    assert right >= 0.9 * len(hidden) and wrong <= 0.05 * right


def test_scores_match_a_plain_computation(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(2), c, f"v{rng.randrange(12)}"): (rng.randrange(1, 5), rng.random() < 0.3) for c in range(8) for _ in range(5)}
    totals = {c: 40 + c for c in range(8)}
    df = spark.createDataFrame([(*k, *v) for k, v in edges.items()], "kind int, context long, value string, n long, seed boolean")
    trust, scores = score(df, spark.createDataFrame(list(totals.items()), "context long, total long"))
    seeds = {(k, v) for (k, _, v), (_, seed) in edges.items() if seed}
    value = {(k, v): float((k, v) in seeds) for k, _, v in edges}
    for _ in range(3):
        mass, miss = {}, {}
        for (k, c, v), (n, _) in edges.items():
            mass[k, c] = mass.get((k, c), 0) + n * value[k, v]
        sure = {kc: min(m / (totals[kc[1]] + 1), 0.99) for kc, m in mass.items()}
        for k, c, v in edges:
            miss[k, v] = miss.get((k, v), 1) * (1 - sure[k, c])
        value = {kv: 1.0 if kv in seeds else 1 - m for kv, m in miss.items()}
    assert {(r.kind, r.context): round(r.confidence, 9) for r in trust.collect()} == {k: round(v, 9) for k, v in sure.items()}
    assert {(r.kind, r.value): round(r.score, 9) for r in scores.collect()} == {k: round(v, 9) for k, v in value.items()}
