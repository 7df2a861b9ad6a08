"""run() against a plain Python version of its five stages."""

import hashlib
import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cytolake.llm import bpe, secrets, toxicity

from .test_ops import brute_base, brute_components, brute_sets, prose


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(90):
        t = prose(rng, rng.choice((4, 30, 60, 120)))
        if i % 6 == 0:
            t += " you zorkwit " + prose(rng, 8)
        if i % 10 == 1:
            t += f" password = secretvalue{i} " + prose(rng, 3)
        if i % 10 == 3:
            t += " api_key: copiedexample1 " + prose(rng, 3)
        rows.append((i, t, "en", None if i % 9 == 4 else f"s{i % 5 if i % 2 else 0}", len(t)))
    for i in range(7, 40, 8):
        rows.append((100 + i, rows[i][1], "en", "s1", rows[i][4]))
        rows.append((200 + i, rows[i][1].replace(rows[i][1].split()[2], "other", 1), "en", "s2", rows[i][4]))
    return rows + [(300, None, "en", "s0", 0), (301, "", "en", "s9", 0), (302, "Licensed <|endoftext|> ÉTÉ", "fr", "s9", 26)]


def without_toxic(rows, labels):
    y = dict(labels)
    sample = [(t or "", y[i]) for i, t, *_ in sorted(rows) if i in y and zlib.crc32(str(i).encode()) % 5]
    m = toxicity.Model(sample)
    hits = toxicity.Hits(m.lexicon)
    return [r for r in rows if m.score(np.array([toxicity.features(r[1] or "", hits)]))[0] < 0.5]


def one_of_each(rows):
    return [r for r, (i, n, c) in zip(rows, brute_components(brute_sets(rows)), strict=True) if n == 0 or i == c]


def masked(rows):
    found = {}
    for r in rows:
        base = secrets.base_spans(r[1] or "")
        found[r[0]] = [(s, e, v) for s, _, e, v in base + secrets.extra_spans(r[1] or "", base)]
    assert all([(s, e) for s, e, _ in found[r[0]]][: len(brute_base(r[1]))] == [(s, e) for s, _, e in brute_base(r[1])] for r in rows)
    owners, repos = {}, {}
    for r in rows:
        for _, _, v in found[r[0]]:
            repos.setdefault(v, set()).add(r[0])
            if r[3] is not None:
                owners.setdefault(v, set()).add(r[3])
    out = []
    for r in rows:
        t = r[1]
        for s, e, v in sorted(found[r[0]], reverse=True):
            if not (len(owners.get(v, ())) >= 3 and len(repos[v]) >= 3):
                t = t[:s] + "[SECRET]" + t[e:]
        out.append((r[0], t, r[2], r[3], len(t) if t is not None else None))
    return out


def mixed(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    u = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in size}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    target, open_, rest = {}, set(names), float(sum(total.values()))
    while True:  # share what is left, take out what is full, again
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
        rest -= sum(target[s] for s in full)
        open_ -= full
        if not open_:
            break
    out = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: u[r[0]])
        copies = 3 if target[s] >= 3 * total[s] else int(target[s] // total[s]) if total[s] else 0
        budget, taken = target[s] - copies * total[s], 0
        more = set()
        for r in own:
            n = size[r[0]]
            if budget > 0 and (taken + n <= budget or n < 2 * (budget - taken)):
                more.add(r[0])
            taken += n
            if taken > budget:
                break
        for r in own:
            out += [r] * (copies + (r[0] in more)) if size[r[0]] else []
    return out


def test_run_is_its_stages_one_by_one(spark, tmp_path):
    rows = corpus()
    labels = [(i, int("zorkwit" in (t or ""))) for i, t, *_ in rows if i % 7]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in mixed(masked(one_of_each(without_toxic(rows, labels)))):
        ids = library.encode(r[1], add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


#: Names that the operators use inside, and plain letters.
NAMES = (
    "c0 c1 c5 key_ repo_ cuts_ hash_ id_ mix_size_ mix_u_ repo owner found rid h start kind end spans cuts live example base_sha256 cls n root text_hash row_key point regular class_id hash id "
    "component_id unit a b src size u v copies budget edge edge2 more any_text times nth place copy task before target source_size word rank score label_ y held_out predicted ids n_tokens row struct"
).split()


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """Every name that a stage uses inside may be a column of the documents: same rows as without, and values kept."""
    rows = corpus()
    spark.createDataFrame([(i, 1, int("zorkwit" in (t or ""))) for i, t, *_ in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = spark.createDataFrame([(*r, *(f"{n}:{r[0]}" for n in NAMES)) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in NAMES)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, str(tmp_path)), stage(spark, more, str(tmp_path))
        assert got.columns == more.columns, name
        found = got.collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(map(tuple, want.collect()), key=repr), name
        assert all(tuple(r)[5:] == tuple(f"{n}:{r.doc_id}" for n in NAMES) for r in found), name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(last(spark, more, str(tmp_path)).collect()) == sorted(last(spark, plain, str(tmp_path)).collect())
