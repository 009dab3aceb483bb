import numpy as np
import corpus_pipeline
from pointloom.llm import langid, mixing, packing, simhash, suffix_dedup

NAMES = ["language", "near_duplicates", "repeats", "mix", "pack"]


def documents(spark):
    rng = np.random.default_rng(0)
    words = {"en": "the and of with from this that was are here there over under".split(), "de": "der die und mit von das ist nicht über unter auch sich".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(words[lang], 2)) if rng.random() < 0.7 else rng.choice(words[lang]) for _ in range(n))
    passage = text("en", 60)
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, text(lang, 150), lang, f"s{i % 4}" if i % 7 else None))
    rows += [(60, rows[1][1], "en", "s1"), (61, rows[2][1] + " more", "en", "s1"), (62, None, "en", "s0"), (63, "12 % 34", "en", "s0"), (64, "", None, None)]
    rows += [(65 + k, f"{text('en', 40)} {passage} {text('en', 40)}", None, "s2") for k in range(3)]
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long"), rows, passage


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, rows, passage = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    known, single, cut, mixed, packed = (f.toPandas() for f in frames[1:])
    assert all(list(x.columns) == docs.columns for x in (known, single, cut, mixed))
    assert set(known.doc_id) == {r[0] for r in rows} - {62, 63, 64}
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in known.itertuples()}
    first = {i: min(j for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in fps}
    assert 60 not in set(single.doc_id) and set(single.doc_id) >= {i for i in fps if first[i] == i} - {61}
    want = suffix_dedup.brute_force([(r.doc_id, r.text.encode()) for r in single.itertuples()])
    assert {r.doc_id: len(r.text.encode()) for r in cut.itertuples()} == {k: v[0] - v[1] for k, v in want.items() if v[0] > v[1]}
    assert sum(passage in t for t in cut.text) == 1 and (cut.n_chars == cut.text.str.len()).all()
    goal = {r.source: r.target for r in mixing.mix(frames[3]).join(frames[3].select("doc_id", "source"), "doc_id").collect()}
    mixed["size"] = mixed.text.str.split().str.len()
    for source, g in mixed.groupby("source", dropna=False):
        assert abs(g["size"].sum() - goal[source if isinstance(source, str) else None]) <= 1
    whole = {r.doc_id: r.text for r in cut.itertuples()}
    assert all(whole[r.doc_id].startswith(r.text) for r in mixed.itertuples())
    ids = packing.TextIds.get(*packing.public_tokenizer())
    assert packed.length.sum() == sum(len(ids.of(t)) // 4 + 1 for t in mixed.text)
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert list(again.columns) == list(packed.columns) and again.length.sum() == packed.length.sum()


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    docs, _, _ = documents(spark)
    wide = docs.selectExpr("*", "1 as fp", "'x' as row", "2 as size", "3 as a")
    for k, frame in enumerate((wide.limit(0), wide.where("doc_id < 8").unionAll(wide.where("doc_id < 3").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "fp", "row", "size", "a")))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            if name != "pack":
                assert out.columns == wide.columns
                out.write.parquet(str(tmp_path / f"{k}-{name}"))
                frame = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            else:
                assert (out.count() > 0) == (k == 1)
