"""The pipeline's stages and the whole of it against a plain form in Python."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    vocabulary = {"en": [f"{a}{b}ing" for a in "bcdfgkl" for b in "aeiou"], "de": [f"{a}{b}ßen" for a in "mnprstv" for b in "äöüie"]}
    rows = []
    for i in range(70):
        lang = "de" if i % 3 else "en"
        text = " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(40)) * (k % 7 == 0) for k in range(rng.randint(60, 150)))
        rows.append([i, f"{text}\nShared footer of the site\nContact us here" if i % 4 == 0 else text, lang if i % 5 else None, f"s{i % 4}", 0])
    for i in range(10):
        rows.append([100 + i, rows[i][1], rows[i][2], "copy", 0])
        words = rows[20 + i][1].split(" ")
        words[3] = "changed"
        rows.append([200 + i, " ".join(words), rows[20 + i][2], "near", 0])
    rows += [list(rows[5]), list(rows[5]), [300, None, None, None, None], [301, "", "en", "s0", 0], [302, "too short", "en", "s0", 9], [None, rows[40][1] + " tail", "en", "s9", 0], [None, rows[41][1] + " end", "de", "s9", 0], [None, rows[41][1] + " ende", "de", None, 0]]
    return [tuple(r) for r in rows]


def plain_quality(rows):
    norm = lambda x: " ".join(WORD.findall(x.translate({c: c + 32 for c in range(65, 91)})))
    held, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in rows:
        lines = [y for x in (text or "").split("\n") if (y := norm(x))]
        if lines:
            hosts[source or ""].add(tuple(lines))
        for x in lines:
            held[source or "", x].add(tuple(lines))
    gone = {k for k, v in held.items() if len(v) > 4 and len(v) > 0.01 * len(hosts[k[0]])}
    out = []
    for i, text, lang, source, _ in rows:
        words = WORD.findall(text or "")
        runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {p for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        left = [x for x in (text or "").split("\n") if (source or "", norm(x)) not in gone]
        removed = len(words) - sum(len(WORD.findall(x)) for x in left)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and removed <= 0.5 * len(words):
            out.append((i, "\n".join(left), lang, source, len("\n".join(left))))
    return out


def plain_exact(rows):
    best = {}
    for r in rows:
        old = best.get(r[1] or "")
        if old is None or (r[0] is not None and (old[0] is None or r[0] > old[0])):
            best[r[1] or ""] = r
    return list(best.values())


def plain_near(rows):
    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    of = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        of[g].append(r)
    return [[r for r in rs if (r[0] is None, r[0]) == min((x[0] is None, x[0]) for x in rs)] for rs in of.values()]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=repr)


def test_stages_equal_their_plain_forms(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clean = P.quality_stage(spark, docs, "")
    wanted = plain_quality(rows)
    assert rows_of(clean) == sorted(wanted, key=repr) and len(wanted) > 80
    exact = P.exact_stage(spark, docs, "")
    assert sorted(((r[0], r[1] or "") for r in rows_of(exact)), key=repr) == sorted(((r[0], r[1] or "") for r in plain_exact(rows)), key=repr)
    kept = Counter(rows_of(P.near_stage(spark, docs, "")))
    groups = plain_near([r for r in rows if WORD.findall(r[1] or "")])
    for candidates in groups:
        chosen = set(candidates) & set(kept)
        assert len(chosen) == 1  # of several null ids any one
    assert len(kept) == len(groups) + 2
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_the_whole_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    kept = Counter(r["doc_id"] for r in got)
    left = plain_exact(plain_quality(rows))
    wanted = Counter()
    for candidates in plain_near(left):
        wanted[candidates[0][0]] += 1
    assert kept == wanted
    # Bins hold what they may, and no source twice.
    sources = {r[0]: r[3] for r in rows if r[0] is not None}
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for held in bins.values():
        spans = sorted((r["offset"], r["offset"] + r["length"]) for r in held)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        named = [sources[r["doc_id"]] for r in held if r["doc_id"] is not None]
        assert len(named) == len(set(named))
