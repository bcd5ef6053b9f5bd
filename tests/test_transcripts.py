"""Values of the transcript queries against plain loops, and recordings as files."""

import re
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest

from inkweave.plans import text_queries
from inkweave.session import prepare
from inkweave.sources import audio

SMALL = "/root/testdata/sf0.001"


def letters(text):
    return re.sub("[^a-z0-9]", "", text.lower())


def ratio(a, b):
    return SequenceMatcher(None, letters(a), letters(b)).ratio()


def subsequence(a, b):
    row = np.zeros(len(b) + 1, int)
    codes = np.array([ord(c) for c in b])
    for x in a:
        grown = row.copy()
        grown[1:] = np.where(codes == ord(x), row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(grown)
    return row[-1]


@pytest.fixture(scope="module")
def recordings(spark):
    out = defaultdict(list)
    for r in sorted(text_queries._recordings(prepare(spark), SMALL).collect(), key=lambda r: (r.rec_id, r.idx)):
        out[r.rec_id].append(r)
    return out


def spoken_words(rows):
    out = []
    for r in rows:
        said = (r.text or "").split()
        part = (r.end - r.start) / max(1, len(said))
        out += [(w, r.start + i * part, r.start + (i + 1) * part) for i, w in enumerate(said) if letters(w)]
    return out


def test_fuzzy_ratios(spark, data):
    from pyspark.sql import functions as F

    ideas = {r.k: r.d for r in spark.read.parquet(f"{data}/base_ideas.parquet").groupBy(F.col("id").alias("k")).agg(F.max("description").alias("d")).collect()}
    want = {}
    for r in spark.read.parquet(f"{data}/decisions.parquet").where("idea is not null").collect():
        if r.idea.key in ideas:
            a, b = r.idea.idea, ideas[r.idea.key]
            if a is None:
                continue
            if b is None:
                want[r.decision_id, a] = (None, None)
            else:
                x, y = (re.sub(r"[^\w\s]", "", t.lower()).strip() for t in (a, b))
                want[r.decision_id, a] = (round(ratio(a, b), 6), round(200 * subsequence(x, y) / (len(x) + len(y)) if x or y else 100, 6))
    got = sorted(((r.decision_id, r.ratio, r.subsequence) for r in text_queries.fuzzy_versions(prepare(spark), data).collect()), key=str)
    assert got == sorted(((k[0], *v) for k, v in want.items()), key=str) and len(got) > 100


def test_span_search(spark, recordings):
    """The first of the best spans, over all spans; a sample of the quotes, all in the result."""
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    got = {(r.rec_id, r.quote_id): r for r in text_queries.span_search(prepare(spark), SMALL).collect()}
    assert len(got) == sum(map(len, recordings.values()))
    for rec, rows in list(recordings.items())[:4]:
        words, quote = spoken_words(rows)[:60], rows[1]
        wanted, best = plain(quote.text), None
        for i in range(len(words)):
            for j in range(i, min(len(words), i + 40)):
                said = plain(" ".join(w for w, _, _ in words[i : j + 1]))
                score = 200 * subsequence(said, wanted) / max(1, len(said) + len(wanted))
                if score >= 70 and (words[j][2] - words[i][1]) * 1000 <= (j - i + 1) * 1500 and (best is None or score > best[2] + 1e-9):
                    best = (words[i][1], words[j][2], score)
        found = got[rec, quote.idx]
        assert best and (found.start, found.end, round(found.score, 6)) == (best[0], best[1], round(best[2], 6))


def test_tiered_match(spark, recordings):
    """By the four tiers, written out."""
    clean = lambda t: " ".join(re.sub(r"[^A-Za-z0-9\s-]", " ", t).split())
    long = lambda t: sum(len(w) > 5 for w in t.split())
    got = {(r.rec_id, r.context_id): (r.start, r.end, r.tier) for r in text_queries.tiered_match(prepare(spark), SMALL).collect()}
    for rec, rows in recordings.items():
        said = [clean(r.text) for r in rows]
        count = defaultdict(int)
        for t in said:
            for w in t.split():
                count[w] += 1
        for quote in rows:
            wanted = clean(quote.text)
            like = [SequenceMatcher(None, t, wanted).ratio() for t in said]
            want = None
            for least in (12, 10, 8, 6):
                hits = [i for i, t in enumerate(said) if long(t) >= least and len(t) >= 15 and (t in wanted or like[i] >= 0.6)]
                if hits:
                    run = [i for n, i in enumerate(hits) if i == hits[0] + n]
                    want = (min(rows[i].start for i in run), max(rows[i].end for i in run), "strong")
                    break
            if want is None:
                rare = {w for w in wanted.split() if len(w) >= 4 and count[w] <= 2}
                scored = []
                for i, t in enumerate(said):
                    hit = rare & set(t.split())
                    if hit and any(len(w) > 5 and w in wanted.split() and w != w.upper() for w in t.split()):
                        scored.append((0.7 * like[i] + 0.3 * (len(hit) + 2 * sum(w.isupper() for w in hit) + 2 * sum("-" in w for w in hit)), -i))
                if scored:
                    i = -max(scored)[1]
                    want = (rows[i].start, rows[i].end, "rare-anchor")
            if want is None:
                i = max(range(len(rows)), key=lambda i: (like[i], long(said[i]), -i))
                want = (rows[i].start, rows[i].end, "weak" if like[i] >= 0.4 and long(said[i]) >= 3 else "very weak")
            assert got[rec, quote.idx] == want


def test_clip_alignment(spark, recordings):
    """The rounds of moving both ends, written out."""
    def anchored(text, target):
        if len(text) < 200:
            return ratio(text, target)
        return max(max(ratio(text[i : i + 200], target) for i in range(len(text) - 199)), 0.0)

    got = {(r.rec_id, r.clip_id): (r.start_ms, r.end_ms, round(r.score, 9)) for r in text_queries.clip_alignment(prepare(spark), SMALL).collect()}
    for rec, rows in list(recordings.items())[:6]:
        words = [(w, int(s * 1000), int(e * 1000)) for w, s, e in spoken_words(rows)]
        for clip in rows:
            start, end, score = int(clip.start * 1000 - 700), int(clip.end * 1000 + 900), 0.0
            for n in range(20):
                text = " ".join(w for w, s, e in words if start <= s and e <= end)
                score, share = ratio(text, clip.text), len(text) / max(1, len(clip.text))
                edge = [ratio(text[:200], clip.text[:200]), ratio(text[-200:], clip.text[-200:])]
                best = [anchored(text, clip.text[:200]), anchored(text, clip.text[-200:])]
                step = int(int(max(1_500, (end - start) * 0.05)) * (1 - n / 20))
                does = ["contract" if e - b < -0.1 else "extend" if e - b > 0.1 else "ok" for e, b in zip(edge, best)]
                apart = [abs(e - b) for e, b in zip(edge, best)]
                if share < 0.8:
                    start, end = (max(0, start - step), end) if apart[0] <= apart[1] else (start, end + step)
                elif share > 1.2:
                    start, end = (start + step, end) if apart[0] >= apart[1] else (start, end - step)
                elif does == ["ok", "ok"]:
                    break
                else:
                    start = {"contract": start + step, "extend": max(0, start - step), "ok": start}[does[0]]
                    end = {"contract": end - step, "extend": end + step, "ok": end}[does[1]]
            assert got[rec, clip.idx] == (start, end, round(score, 9))


def test_wav_files(spark, tmp_path):
    tone = np.sin(np.arange(800) / 5) * 0.5
    (tmp_path / "a.wav").write_bytes(audio.encoded(tone, 100))
    (tmp_path / "b.wav").write_bytes(b"no recording")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].rate == 100 and np.allclose(rows["a.wav"].samples, tone, atol=1e-4) and rows["b.wav"].error and rows["b.wav"].samples is None
    half = audio.read_wav(spark, str(tmp_path), 50).where("error is null").first()
    assert half.rate == 50 and len(half.samples) == 400 and np.allclose(half.samples, tone[::2], atol=1e-3)
    parts = audio.chunked(audio.read_wav(spark, str(tmp_path)), 3, 1).orderBy("chunk").collect()
    assert [(p.chunk, p.offset, len(p.samples)) for p in parts] == [(0, 0.0, 400), (1, 3.0, 400), (2, 6.0, 200)]
    assert audio.resampled(np.zeros(0), 10, 20).size == 0
