"""Every operator against a plain version on small rows, and the odd cases its docstring defines."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from telemill.llm import components, exact, language, lines, minmax, mixing, pieces, quality, secrets, toxicity, vectors
from telemill.llm.groups import whole_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact(spark, rows, documents, odd_ids, empty, tmp_path):
    documents.write.parquet(str(tmp_path / "a"))
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    got = by_id(exact.dedup(spark, str(tmp_path / "a")))
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), sha(text))
    odd_ids.write.parquet(str(tmp_path / "b"))
    assert exact.dedup(spark, str(tmp_path / "b")).count() == odd_ids.count()
    empty.write.parquet(str(tmp_path / "c"))
    assert exact.dedup(spark, str(tmp_path / "c")).count() == 0


def test_exact_divides_a_digest_with_two_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa")], "doc_id bigint, text string").write.parquet(str(tmp_path / "a"))
    monkeypatch.setattr(exact.F, "sha2", lambda column, bits: exact.F.lit("ab" * 32))
    got = by_id(exact.dedup(spark, str(tmp_path / "a")))
    assert [(got[i].keep_id, got[i].group_size) for i in (1, 2, 3)] == [(3, 2), (2, 1), (3, 2)]


def test_exact_goes_on_with_new_files(spark, tmp_path):
    schema = "doc_id bigint, file string, raw bigint, digest binary"
    spark.createDataFrame([(1, "f", 0, b"x")], schema).write.parquet(str(tmp_path / "d"))
    exact.stream_state(spark, str(tmp_path / "d"), str(tmp_path / "s"))
    spark.createDataFrame([(2, "g", 0, b"x")], schema).write.mode("append").parquet(str(tmp_path / "d"))
    state = exact.stream_state(spark, str(tmp_path / "d"), str(tmp_path / "s")).collect()
    assert [(r.keep_id, r.n_rows) for r in state] == [(2, 2)]


def test_mixing(rows, documents, odd_ids, empty):
    got = by_id(mixing.mix(documents))
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    per_source, taken = Counter(), Counter()
    for r in rows:
        per_source[r[3]] += sizes[r[0]]
        taken[r[3]] += got[r[0]].taken
    weights = {"s1": 1, "s2": 2, "s3": 3, None: 1}
    targets, rest, total = {}, dict(weights), sum(per_source.values())
    while True:
        level = (total - sum(targets.values())) / sum(rest.values())
        full = [s for s in rest if level * rest[s] > 3 * per_source[s]]
        if not full:
            break
        for s in full:
            targets[s] = 3 * per_source[s]
            del rest[s]
    targets |= {s: level * w for s, w in rest.items()}
    for r in rows:
        g = got[r[0]]
        assert (g.size, g.source_size) == (sizes[r[0]], per_source[r[3]])
        assert g.target == pytest.approx(targets[r[3]])
        assert 0 <= g.taken <= 3 * g.size and (not g.size or g.taken % g.size == 0)
    # Whole documents only: off by half of the source's largest at most.
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(sizes[r[0]] for r in rows if r[3] == s) / 2 + 1
    again = by_id(mixing.mix(documents))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(odd_ids).count() == odd_ids.count()
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(documents).columns == documents.columns


def plain_lines(rows, min_rows=5):
    split = {r[0]: (r[1] or "").split("\n") for r in rows}
    key = lambda line: line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, parts in split.items():
        for line in parts:
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    for i, parts in split.items():
        left = [x for x in parts if len(holders[key(x)]) < min_rows or max(holders[key(x)]) == i]
        yield i, len(parts), len(parts) - len(left), sha("\n".join(left))


def test_lines(rows, documents, odd_ids, empty):
    got = by_id(lines.dedup_lines(documents))
    assert [(i, got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) for i, *_ in rows] == list(plain_lines(rows))
    assert sum(r.n_dropped for r in got.values()) > 0
    assert lines.dedup_lines(odd_ids).count() == odd_ids.count()
    assert lines.dedup_lines(empty).count() == 0
    assert lines.dropped(documents).columns == [*documents.columns, "n_lines", "n_dropped"]


def test_mixing_reruns_agree_over_layouts(spark, rows):
    """The same rows in other partitions and in another order give the same taken words."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string"
    many = [(1000 + k, r[1], r[2], r[3], r[4], r[5]) for k, r in enumerate(rows * 3)]
    layouts = [
        spark.createDataFrame(many, schema).repartition(1),
        spark.createDataFrame(list(reversed(many)), schema).repartition(7),
        spark.createDataFrame(many, schema).repartition(13, "source"),
    ]
    results = [sorted((r.doc_id, r.taken) for r in mixing.mix(frame).collect()) for frame in layouts]
    assert results[0] == results[1] == results[2]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64))
    table = lines.PerfectHash.loaded(*lines.PerfectHash.build(keys).stored())
    assert sorted(table.slots(keys)) == list(range(len(keys)))


def plain_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return label


def test_components(spark):
    rng = np.random.default_rng(2)
    linked = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(250, 299)]
    expected = plain_components(300, linked)
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(linked, "a bigint, b bigint")).collect()}
    assert all(got.get(k, k) == expected[k] for k in range(300))


@pytest.mark.parametrize("width", [2, 5])
def test_minmax(rows, documents, odd_ids, empty, width):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    linked = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = plain_components(len(rows), linked)
    least = defaultdict(lambda: 10**9)
    for k, r in enumerate(rows):
        least[label[k]] = min(least[label[k]], r[0])
    got = by_id(minmax.near_duplicates(documents, width))
    for k, r in enumerate(rows):
        g = got[r[0]]
        assert (g.n_shingles, g.component_id, g.kept) == (len(sets[k]), least[label[k]], r[0] == least[label[k]])
    if width == 2:
        assert minmax.near_duplicates(odd_ids, width).count() == odd_ids.count()
        assert minmax.near_duplicates(empty, width).count() == 0
        kept = minmax.dedup(documents, width)
        assert kept.columns == documents.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_of_a_cell_in_many_blocks(spark, monkeypatch, block):
    """A cell of many classes is cut into blocks, and some of these hold visitors but no owner."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    near = centres.repeat([*[12] * 11, 90], axis=0)
    found = np.concatenate([near + rng.normal(0, 0.1, near.shape), rng.normal(size=(60, 16))])
    frame = spark.createDataFrame(
        [(k, v.tolist(), 1) for k, v in enumerate(found.astype(np.float32))],
        "vec_id bigint, embedding array<float>, label int",
    )
    x = found.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    label = plain_components(len(x), [tuple(p) for p in np.argwhere(close)])
    monkeypatch.setattr(vectors, "BLOCK", block)
    for r in vectors.near_duplicates(frame).collect():
        assert (r.n_links, r.component_id) == (close[r.vec_id].sum() - 1, label[r.vec_id])


def test_groups_stay_whole_over_batches():
    keys = [0] * 3 + [1] * 9 + [2] + [3] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 2])], names=["k"]) for k in range(0, len(keys), 2)]
    for rows in (1, 4, 100):
        tables = [t.column("k").to_pylist() for t in whole_groups(iter(batches), ["k"], rows)]
        assert sum(tables, []) == keys
        assert sum(len(set(t)) for t in tables) == 4


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    found = np.concatenate([centres, centres[:10].repeat(6, axis=0) + rng.normal(0, 0.12, (60, 16))]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(found)]
    rows += [(200, rows[3][1], 2), (201, rows[3][1], 2), (202, [2 * x for x in rows[3][1]], 2)]
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None, 1.0], 1), (304, [], 1)]
    schema = "vec_id bigint, embedding array<float>, label int"
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows + odd, schema)).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    label = plain_components(len(rows), [tuple(p) for p in np.argwhere(close)])
    for k, r in enumerate(rows):
        g = got[r[0]]
        assert (g.n_links, g.component_id) == (close[k].sum() - 1, rows[label[k]][0])
        assert g.kept == (g.component_id == r[0])
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in odd)
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(5).normal(0, 2, (500, 8))
    point = vectors.nearest_e8(x)
    around = point[:, None, :] + vectors.SHORTEST
    assert (((x - point) ** 2).sum(1)[:, None] <= ((x[:, None, :] - around) ** 2).sum(2) + 1e-9).all()


def test_language(spark, rows, documents, odd_ids, empty):
    texts = [(k, " ".join(["the cat sat on that mat", "der hund und die katze sind da"][k % 2:][:1] * 9), ("en", "de")[k % 2])
             for k in range(60)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    got = by_id(language.identify(frame))
    for i, _, lang in texts:
        assert (got[i].lang_pred, got[i].held_out) == (lang, zlib.crc32(str(i).encode()) % 5 == 0)
    found = by_id(language.identify(documents))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (500, 501, 502, 503))
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(odd_ids).count() == odd_ids.count()
    assert language.identify(empty).count() == 0


def test_a_tiny_language_takes_no_other_documents(spark):
    """One labelled document 'ok' of its own language changes no prediction but its own."""
    texts = [(k, " ".join(["the cat sat on that mat", "der hund und die katze sind da"][k % 2:][:1] * 9), ("en", "de")[k % 2])
             for k in range(60)]
    schema = "doc_id bigint, text string, lang string"
    before = by_id(language.identify(spark.createDataFrame(texts, schema)))
    after = by_id(language.identify(spark.createDataFrame([*texts, (1000, "ok", "xx")], schema)))
    assert all(after[i].lang_pred == before[i].lang_pred for i, _, _ in texts)


def test_cross_parsing_counts_phrases():
    parser = language.Parser({"x": "abcab"})
    codes = parser.classes[language._points("bcabxcc")]
    # bcab | x | c | c
    assert parser.phrases(codes, np.array([len(codes)]))[0, 0] == 4


def test_pieces(rows, documents, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    digests, whole = by_id(pieces.digests(documents, MODEL)), by_id(pieces.encoded(documents, MODEL))
    for r in rows:
        ids = [*library.encode(r[1] or ""), library.eos_id()]
        text = library.decode(ids)
        assert (whole[r[0]].ids, whole[r[0]].decoded) == (ids, text)
        d = digests[r[0]]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert pieces.digests(empty, MODEL).count() == 0


def plain_spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(rows, documents, odd_ids, empty):
    got = by_id(secrets.secrets(documents))
    for r in rows:
        spans = plain_spans(r[1] or "")
        g = got[r[0]]
        texts = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans]
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert g.base_sha256 == sha(",".join(texts)) and set(texts) <= set(g.spans.split(",")) | {""}
    # One value has three owners, the others one.
    assert (got[508].n_example, got[508].n_live, got[509].n_example, got[510].n_live) == (1, 2, 1, 0)
    assert secrets.secrets(odd_ids).count() == odd_ids.count()
    assert secrets.secrets(empty).count() == 0


def test_secrets_copied_within_one_owner(spark):
    rows = [(k, "password=manycopies1", "s1") for k in range(10)] + [(20 + k, "password=fewcopies12", "s1") for k in range(9)]
    rows += [(40 + k, "password=twoowners12", f"s{k % 2}") for k in range(10)]
    rows += [(60 + k, "password=twoandfew12", f"s{k % 2}") for k in range(9)]
    got = by_id(secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    marks = {first: {(r.n_live, r.n_example) for k, r in got.items() if first <= k < first + 20} for first in (0, 20, 40, 60)}
    assert marks == {0: {(0, 1)}, 20: {(1, 0)}, 40: {(0, 1)}, 60: {(0, 0)}}


@pytest.mark.parametrize("operator, column", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers(spark, documents, odd_ids, empty, operator, column):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    texts = []
    for k in range(900):
        parts = list(rng.choice(vocabulary, 40))
        if k % 3 == 0:
            parts[5], parts[20] = "dreadful", "dreadful"
        texts.append((k, " ".join(parts), None, None, len(" ".join(parts)), None))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint, x string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), None) for k in range(900)], f"doc_id bigint, {column} int, other int")
    got = by_id(operator(frame, labels))
    held = [(i, r) for i, r in got.items() if r.held_out]
    assert np.mean([r.predicted == (i % 3 == 0) for i, r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert operator(documents, labels).count() == documents.count()
    assert operator(odd_ids, labels).count() == odd_ids.count()
    assert operator(empty, labels).count() == 0
    assert {r.score for r in operator(documents, labels.limit(0)).collect()} == {0.5}
