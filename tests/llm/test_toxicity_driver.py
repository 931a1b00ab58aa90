import numpy as np
import pyarrow as pa

from loomtide.llm import toxicity


def test_training_takes_place_in_tasks_and_gives_the_same_model(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in draw.integers(0, 300, 200)) + (" zorg" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(7)
    kinds, here, frame, train = [], [], type(df), toxicity.train
    to_arrow = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: kinds.extend(t for _, t in self.dtypes) or to_arrow(self))
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: here.append(1) or train(*a, **k))
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    # Tasks run in processes of their own: what is counted here is the driver's.
    assert "binary" not in kinds and not here

    words, y = [toxicity.word_ids(pa.array([r[1]]))[0] for r in rows], np.array([r[3] for r in rows], float)
    test = np.arange(len(rows)) % 5 == 0
    flat = np.concatenate([w for w, t in zip(words, test, strict=True) if t])
    ends = np.concatenate([[0], np.cumsum([len(w) for w, t in zip(words, test, strict=True) if t])])

    def loss(m):
        p = np.clip(m.scores(flat, ends), 1e-9, 1 - 1e-9)
        return -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()

    want = min((train([w for w, t in zip(words, test, strict=True) if not t], y[~test], seed=s) for s in toxicity.SEEDS), key=loss)
    assert np.allclose(model.tables, want.tables, atol=1e-5) and np.allclose(model.out, want.out, atol=1e-5)
    assert set(model.thresholds) == {""}  # fewer than LEAST toxic rows are held out


def test_packed_words_pick_the_same_rows():
    hashes = np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    back, low, high = toxicity.unpacked(toxicity.packed(hashes)), np.uint64((1 << toxicity.TABLE_BITS) - 1), np.uint64(64 - toxicity.TABLE_BITS)
    assert (back & low == hashes & low).all() and (back >> high == hashes >> high).all()
