from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
from lodestar.llm import _util, packing, pii

from . import cases
from .test_quality import BAD
from .test_setsketch import brute, shingles


def corpus():
    data = [(i, cases.prose(i, 60 + i % 90), "en", "hot" if i % 3 else "rare", 1) for i in range(200)]
    data += [(1000 + i, cases.prose(i, 60 + i % 90), "en", "copy", 1) for i in range(30)]
    data += [(2000 + i, " ".join([BAD[i % 3]] * (2 + i % 5)), "en", "hot", 1) for i in range(60)]
    data += [(3000 + i, f"{cases.prose(800 + i, 70)} Mail person{i}@corp{i}.example about it. {cases.prose(900 + i, 20)}", "en", "rare", 1) for i in range(10)]
    return data


def stages(spark, docs, tmp):
    """Each stage's rows, written and read as the driver does it."""
    out = [docs]
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, out[-1], "").write.parquet(f"{tmp}/{k}")
        out.append(spark.read.parquet(f"{tmp}/{k}"))
    return out


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = cases.plain(spark, corpus())
    _, good, unique, private, mixed, packs = stages(spark, docs, tmp_path)
    for df in (good, unique, private, mixed):
        assert df.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert len(set(kept) & set(range(200))) >= 196 and not any(2000 <= d < 3000 for d in kept)
    ids = sorted(kept)
    root = brute([kept[i] for i in ids], 0.5)
    assert sorted(r.doc_id for r in unique.collect()) == [i for k, i in enumerate(ids) if root[k] == k]
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (unique, private))
    assert before.keys() == after.keys()
    for d, t in after.items():
        assert "@" not in t and (t == before[d] or pii.entities(before[d]))
    times = Counter(r.doc_id for r in mixed.collect())
    by, n = Counter(), Counter()
    source = {r.doc_id: r.source for r in private.collect()}
    for d, t in after.items():
        by[source[d]] += len(t)
    w = {s: c**0.5 for s, c in by.items()}
    lam = {s: w[s] / sum(w.values()) * sum(by.values()) / by[s] for s in by}
    for d in after:
        assert times[d] in (int(lam[source[d]]), int(lam[source[d]]) + 1)
        n[source[d]] += times[d] - lam[source[d]]
    assert all(abs(x) < 1.001 for x in n.values())
    rows = packs.collect()
    assert sum(r.used for r in rows) == sum(len(r.text) for r in mixed.collect())
    assert all(len(r.text) == r.used <= packing.Config().capacity for r in rows)


def test_run_and_its_hard_rows(spark, tmp_path):
    cases.plain(spark, corpus() + cases.rows()).write.parquet(f"{tmp_path}/documents.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and len({r.pack_id for r in rows}) == len(rows)


def test_empty(spark, tmp_path):
    cases.plain(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_checkpoint_folder(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]
    assert _util.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", _util.shared_dir(spark)) and shingles("a b c d") == {("a", "b", "c"), ("b", "c", "d")}


def test_entry_has_the_ten_and_the_pipeline():
    import __spark_entry__ as E

    names = E.queries().keys()
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)


def test_string_ids_and_clashing_columns(spark, tmp_path):
    wide = cases.wide(spark, corpus()[:60] + cases.rows())
    wide = wide.withColumn("doc_id", wide["doc_id"].cast("string"))
    *docs, packs = stages(spark, wide, tmp_path)
    assert all(df.columns == wide.columns for df in docs)
    assert packs.count() and {d for r in packs.collect() for d in r.doc_ids} <= {r.doc_id for r in wide.collect()}
