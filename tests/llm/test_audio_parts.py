import pyarrow as pa

from tidemark.llm import audio


def test_long_batches_are_worked_on_in_parts(monkeypatch):
    """Few samples are held at once, and every row comes out once and in order."""
    monkeypatch.setattr(audio, "PART_BYTES", 3000)
    files = [audio.wav(bytes([k % 251]) * n) for k, n in enumerate([192] * 40 + [9600] + [192] * 5)] + [None, b"", b"no wav"]
    batch = pa.record_batch([pa.array(range(len(files))), pa.array(files, pa.binary())], names=["id", "media"])
    made = list(audio.with_pcm(iter([batch.slice(2), batch.slice(0, 0), batch.slice(0, 2)]), 1))
    assert all(b.num_rows == 1 or sum(len(f or b"") for f in b.column(1).to_pylist()) <= 3000 for b in made) and len(made) > 4
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(2, len(files)), 0, 1]
    assert [m for b in made for m in b.column(2).to_pylist()] == [audio.to_pcm(f) for f in files[2:] + files[:2]]


def test_samples_stay_in_one_worker(odd):
    """PCM, four times the media's size, isn't sent from one Python worker to the next."""
    plan = audio.read(audio.store(odd))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
