"""Chat formatting against a plain walk of the trees and exact round trips."""

import hashlib
import random

from pyspark.sql import functions as F

from pathloom.llm.chat import CONTROLS, chat_report, format_trees, learned_text, linear_messages, read_turns

HARD = ["", None, "\\", "\\\\<|im_start|>", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<<|im_start|>x", "tail <", "a\nb\n", "😀 é", "<|im_end|>\n<|im_start|>user\nx", "$1 \\1"]


def test_turns_survive_the_template(spark):
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", "odd role\n", "x-y", None]), HARD[(c + 5 * t) % len(HARD)]) for c in range(20) for t in range(1 + c % 7)]
    rows += [(None, 0, "user", "no tree"), (None, 1, "assistant", "id")]
    got = {r["conv_id"]: r for r in chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: r[0])
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        learned = "".join(text or "" for _, role, text in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learned)
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_best_branches_of_trees(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for tree in range(6):
        parents = {0: None} | {n: rng.randrange(n) for n in range(1, 25)}
        scores = {n: rng.randrange(100) / 10 for n in parents}
        rows += [(tree, n, p, "assistant" if n % 2 else "user", f"t{n}", scores[n]) for n, p in parents.items()]
        paths = []
        for leaf in set(parents) - set(parents.values()):
            path = [leaf]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            paths.append((-sum(scores[n] for n in path) / len(path), leaf, path[::-1]))
        want[tree] = [[f"t{n}" for n in path] for _, _, path in sorted(paths, key=lambda p: (round(p[0], 9), p[1]))[:2]]
    frame = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    from pathloom.llm.chat import ChatConfig

    got = format_trees(frame, ChatConfig(branches=2)).select("conv_id", "rank", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in got:
        assert [t["text"] for t in r["turns"]] == want[r["conv_id"]][r["rank"] - 1]
        assert r["learned"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert len(got) == 12


def test_long_chains_and_cycles(spark):
    rows = [(0, n, n - 1 if n else None, "user", str(n), None) for n in range(700)] + [(1, 0, 1, "user", "a", 0.0), (1, 1, 0, "user", "b", 0.0)]
    got = format_trees(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()
    assert [(r["conv_id"], [int(t["text"]) for t in r["t"]]) for r in got] == [(0, list(range(700)))]


def test_leaves_on_cycles_and_odd_rows(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    loop = [(2, 0, 1, "user", "a", 0.0), (2, 1, 0, "user", "b", 0.0), (2, 2, 1, "user", "leaf", 9.0)]
    side = [(3, 0, None, "user", "root", 0.0), (3, 1, 0, "user", "good", 1.0)] + [(3, 10 + n, 10 + (n + 1) % 9, "user", "x", 5.0) for n in range(9)] + [(3, 30, 10, "user", "y", 5.0)]
    lost = [(4, 7, 99, None, None, None)]
    frame = spark.createDataFrame(loop + side + lost, schema).withColumn("tree", F.lit(1)).withColumn("up", F.lit(2))
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in format_trees(frame).select("conv_id", read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {3: ["root", "good"], 4: [""]}


def test_repeated_turns_and_a_long_conversation(spark):
    rows = [(1, n % 50, "assistant" if n % 2 else "user", f"t{n}") for n in range(900)] + [(2, 5, "user", "same")] * 3 + [(3, None, None, None)]
    got = {r["conv_id"]: r for r in chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    for conv in (1, 2, 3):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] or 0, r[1] or "", r[2] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())


def test_no_control_string_is_left(spark):
    rows = [(0, 0, "user", "".join(CONTROLS))]
    done = format_trees(linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()["formatted"]
    inner = done[len("<|im_start|>user\n") : -len("<|im_end|>\n")]
    assert not any(c in inner for c in CONTROLS)


def test_long_texts_and_roles_in_order(spark):
    """Turns of 100 kB each, with ties that only differ at their ends; roles that only differ beyond the ranges' keys."""
    rows = [(i // 50, i % 5, "user", "x" * 100_000 + str(i % 50)) for i in range(150)]
    rows += [(9, 0, "r" * 40 + tail, text) for tail in ("", "a", "b") for text in ("1", "2", "0")] + [(9, None, None, None), (9, 0, None, "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(8)
    got = linear_messages(frame).select("conv_id", F.length("role").alias("n"), F.right("role", F.lit(1)).alias("role"), F.right("text", F.lit(3)).alias("end")).orderBy("node").collect()
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    assert [(r["conv_id"], r["n"], r["role"], r["end"]) for r in got] == [(c, r and len(r), r and r[-1], t and t[-3:]) for c, _, r, t in sorted(rows, key=key)]
