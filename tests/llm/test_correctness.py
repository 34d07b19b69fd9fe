"""The corpus operators against brute force, the tokenizer libraries and exact round trips, on small tables."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bpe, minhash, packing, passages, queries, sharding
from textloom.llm.common import all_shingles, distinct_counts, shingle_hashes, word_hashes
from textloom.llm.line_rules import LineRules, document_stats, without_lines
from textloom.llm.minhash import NearDuplicates

SF = "/root/testdata/sf0.001"
WORDS = [f"word{k}" for k in range(400)]


def lower_words(text):
    return text.encode().lower().split() if text else []


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(reference):
    ranks, library = reference
    own, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(3)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "é", "日", "🙂", "'s", "1", "!", "\x1c", "\x85", " ", "\t", "ing", "A", "&&&", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    decoder = bpe.Decoder(ranks)
    assert decoder.decode(library.encode_ordinary("🙂 日本")) == "🙂 日本"
    stream = bpe.Utf8Stream()
    assert "".join([*(stream.feed(bytes([b])) for b in "é日🙂".encode()), stream.finish()]) == "é日🙂"
    assert bpe.Utf8Stream().feed(b"a\xff\xc3") == "a�"


def test_bpe_query(spark, texts, reference):
    rows = queries.op2_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference[1].encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_token_file_query(spark, texts):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in queries.op5_token_file(spark, SF).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_sharding_query(spark, texts):
    rows = queries.op6_histogram_sharding(spark, SF).collect()
    keys = {r.doc_id: (r.h, r.g) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 4).alias("h"), F.shiftrightunsigned(F.xxhash64("doc_id"), 34).alias("g")).collect()}
    total, at, groups = sum(r.size for r in rows), 0, defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        groups[keys[r.doc_id][0]].append(r)
    slots = Counter()
    for h in sorted(groups):
        size, start = sum(r.size for r in groups[h]), at
        whole = size * 40 <= total  # a border inside the group goes to its nearer end
        first = min(39, start * 40 // total)
        border = (first + 1) * total - start * 40
        mine = first + (first < 39 and 0 < border < size * 40 and 2 * border <= size * 40)
        for r in sorted(groups[h], key=lambda r: keys[r.doc_id]):
            assert r.shard == (mine if whole else min(39, at * 40 // total))
            assert r.slot == slots[r.shard]
            slots[r.shard] += 1
            at += r.size


def test_sharding_keeps_groups_whole_that_fit_a_shard(spark):
    rng = random.Random(3)
    copied = {k: " ".join(rng.choice(WORDS) for _ in range(40)) for k in range(30)}
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(40))) for k in range(600)] + [(1000 + 100 * k + j, t) for k, t in copied.items() for j in range(rng.randint(2, 12))]
    rows += [(9000 + j, "one group that is larger than a shard " * 8) for j in range(150)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    text, shards, bytes_ = dict(rows), defaultdict(set), Counter()
    for r in found:
        shards[text[r.doc_id]].add(r.shard)
        bytes_[r.shard] += r.size
    assert all(len(shards[t]) == 1 for t in copied.values()) and len(shards[text[9000]]) > 1
    assert set(bytes_) == set(range(40)) and max(bytes_.values()) < 1.7 * sum(bytes_.values()) / 40


def test_near_duplicates_query(spark, texts):
    sets = {i: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := lower_words(t)) else set()) for i, t in texts.items()}
    parent, ids = {i: i for i in sets}, sorted(sets)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in queries.op9_minhash_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_large_group_of_near_copies(spark):
    """More members than a block holds, of which neighbours in a chain alone are similar enough."""
    rng = random.Random(5)
    words = [rng.choice(WORDS) for _ in range(300)]
    rows = []
    for k in range(700):
        own = list(words)
        own[rng.randrange(300)] = f"edit{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(rng.choice(WORDS) for _ in range(100))) for k in range(50)]
    found = NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string")).verdicts().collect()
    assert {r.component_id for r in found if r.doc_id < 1000} == {0}
    assert all(r.kept for r in found if r.doc_id >= 1000)


def test_chained_buckets_are_not_one_cluster(spark):
    """Buckets that share a member each tie all items together; an item still goes to a few blocks only."""
    n, wide = 3000, 40
    rows = [(b, b * (wide - 1) + k) for b in range(n // (wide - 1)) for k in range(wide)]
    table = spark.createDataFrame([(b, i, i, b * (wide - 1), 400) for b, i in rows], "bucket long, item long, component long, y long, n long")
    facts = table.select("item", F.lit(400).cast("long").alias("n")).distinct()
    dealt = minhash._dealt(table, facts, minhash.Plan(bands=2)).collect()
    assert {r.item for r in dealt} == {i for _, i in rows}
    assert sum(r.other_blocks + r.main_blocks for r in dealt) <= 3 * len(rows)


def word_places(text):
    """(lower-cased words, number of line ends before each)."""
    words, line_of = [], []
    for k, line in enumerate(text.split("\n")):
        own = lower_words(line)
        words += own
        line_of += [k] * len(own)
    return words, line_of


def brute_passages(texts):
    """For each document the words that must go (in a run of 50 that an earlier document has) and those that may:
    in a run of 16 that another document has, or in a paragraph of a component of similar ones."""
    words = {i: word_places(t or "") for i, t in texts.items()}
    runs16, runs50 = defaultdict(list), defaultdict(list)
    for i, (w, _) in words.items():
        for runs_, n in ((runs16, 16), (runs50, 50)):
            for k in range(len(w) - n + 1):
                runs_[tuple(w[k : k + n])].append((i, k))
    must, may = defaultdict(set), defaultdict(set)
    for found in runs50.values():
        least = min(i for i, _ in found)
        for i, k in found:
            if i != least:
                must[i] |= set(range(k, k + 50))
    for found in runs16.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                may[i] |= set(range(k, k + 16))
    units = []
    for i, (w, line_of) in words.items():
        begins, sizes = passages.paragraphs(np.array([zlib.crc32(x) for x in w], np.uint64), np.array([0, len(w)]), np.array(line_of, np.int64))
        units += [(i, b, n, {tuple(w[k : k + 5]) for k in range(b, b + n - 4)}) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    holders = defaultdict(list)
    for u, (*_, shingles) in enumerate(units):
        for x in shingles:
            holders[x].append(u)
    for u, (i, b, n, shingles) in enumerate(units):
        shared = Counter(v for x in shingles for v in holders[x] if units[v][0] != i)
        if any(100 * both >= 80 * (len(shingles) + len(units[v][3]) - both) for v, both in shared.items()):
            may[i] |= set(range(b, b + n))
    return must, may


def test_passages_query(spark, texts):
    must, may = brute_passages(texts)
    gone = defaultdict(set)
    for r in queries.op10_repeated_passages(spark, SF).collect():
        assert r.source_id <= r.doc_id and not gone[r.doc_id] & set(range(r.first_word, r.first_word + r.n_words))
        gone[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert sum(map(len, must.values())) > 1000
    assert all(must[i] <= gone[i] for i in must)
    assert all(gone[i] <= may[i] for i in gone)


def test_passages_do_not_depend_on_batches_or_wrapping(spark):
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, near = some(51), some(60).split()
    wrapped = lambda text: "\n".join(" ".join(text.split()[k : k + 11]) for k in range(0, len(text.split()), 11))
    edited = " ".join([*near[:30], "edit", *near[31:]])
    rows = [(k, f"{some(rng.randint(5, 90))} {passage} {some(rng.randint(5, 90))}") for k in range(40)]
    rows += [(100, f"{some(30)}\n\n{wrapped(' '.join(near))}"), (101, f"{some(40)}\n\n{wrapped(edited)}"), (101, f"{some(40)}\n\n{wrapped(edited)} x"), (102, ""), (103, None), (104, "few words")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    found = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 50, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, passages.RepeatedPassages(table).stretches().collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] == found[2]
    by_doc = defaultdict(list)
    for doc, key, first, n, source in found[0]:
        by_doc[doc].append((key, first, n, source))
    assert set(range(1, 40)) <= set(by_doc) and 0 not in by_doc and 100 not in by_doc
    assert all(by_doc[k][0][2] >= 51 and by_doc[k][0][3] == 0 for k in range(1, 40))
    assert len(by_doc[101]) == 2 and all(n >= 60 and source == 100 for _, _, n, source in by_doc[101])


def test_vector_forms_of_words_and_shingles():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [None, "", " \n", "A bC  d\u00e9\x0bE", "x" * 70_000 + " y", *(" ".join(rng.choice(WORDS[:30]) for _ in range(rng.randint(0, 40))) for _ in range(50))]
    array = pa.concat_arrays([pa.array(["left out"]), pa.array(texts, pa.string())]).slice(1)
    hashes, places, begins, data = word_hashes(array)
    own = [lower_words(t) for t in texts]
    assert np.diff(places).tolist() == [len(w) for w in own]
    by_word = {}
    for word, h in zip([w for ws in own for w in ws], hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    sizes = np.diff(places)
    shingles, starts = all_shingles(hashes, places[:-1], sizes, 5)
    counts = distinct_counts(shingles, starts)
    for k, w in enumerate(own):
        mine = shingles[starts[k] : starts[k + 1]]
        assert mine.tolist() == shingle_hashes(hashes[places[k] : places[k + 1]], 5).tolist()
        assert counts[k] == len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else ())


def test_nearest_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    found = queries.op7_multi_index_hashing(spark, SF).toPandas()
    hits = total = 0
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = found[found.query_id == ids[at]].sort_values("rank")
        hits += len(set(ids[best]) & set(own.vec_id))
        total += 10
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12)
    assert hits >= 0.9 * total


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_line_rules_remove_boilerplate_and_spare_copies(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    common = line(60)
    own = [(k, f"{line(40)}\n{common}\n{line(30)}", "host") for k in range(60)]
    depleted = [(100 + k, f"{common}\n{line(8)}", "host") for k in range(30)]
    copied = f"{line(50)}\n{line(40)}"
    copies = [(200 + k, copied, "host") for k in range(80)]
    rows = {r.doc_id: r for r in LineRules(spark.createDataFrame(own + depleted + copies, "doc_id long, text string, source string")).verdicts().collect()}
    assert all(rows[k].kept and rows[k].removed_words == 60 for k, *_ in own)
    assert not any(rows[k].kept for k, *_ in depleted)
    assert all(rows[k].kept and rows[k].removed_words == 0 for k, *_ in copies)
    h = next(x["line"] for x in document_stats(common)["lines"])
    assert spark.range(1).select(without_lines(F.lit(f"a\n{common}\nb"), F.array(F.lit(h)))).first()[0] == "a\nb"


def test_line_rules_count_documents_that_share_a_block(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    block = [line(12) for _ in range(5)]
    docs = [(k, "\n".join([*block, line(90)]), "host") for k in range(30)]
    words = line(200).split()
    near = [(100 + k, " ".join([*words[: 5 * k], f"other{k}", *words[5 * k + 1 :]]) + f"\n{' '.join(words[:60])}", "host") for k in range(40)]
    rules = LineRules(spark.createDataFrame(docs + near, "doc_id long, text string, source string"))
    found = {r.line: r.n_docs for r in rules.frequent_lines().collect()}
    # documents that differ in one word are different documents
    ending = document_stats(" ".join(words[:60]))["lines"][0]["line"]
    assert found == {document_stats(x)["lines"][0]["line"]: 30 for x in block} | {ending: 40}
    rows = {r.doc_id: r for r in rules.verdicts().collect()}
    assert all(rows[k].kept and rows[k].removed_words == 60 for k, *_ in docs)
    assert all(rows[k].kept and rows[k].removed_words == 60 for k, *_ in near)


def test_line_rules_query_matches_sql(spark, tmp_path):
    """On the small table, and on one with boilerplate, depleted documents, copies, odd white space and empty texts."""
    import duckdb

    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    footer, copied = [line(60), line(3), "\tOdd  \x0b Space\r"], f"{line(60)}\n{line(9)}"
    rows = [(k, "\n".join([line(rng.randint(1, 80)), *rng.sample(footer, 2), line(rng.randint(0, 5))]), rng.choice(["a", "b", None])) for k in range(150)]
    rows += [(200 + k, copied, "a") for k in range(40)] + [(300, None, "a"), (301, "", None), (302, "é # \u2028 x\n\n é # \u2028 x", "b"), (303, "a b c " * 40, "b")]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/t/documents.parquet")
    for folder, files in ((SF, f"{SF}/documents.parquet"), (f"{tmp_path}/t", f"{tmp_path}/t/documents.parquet/*.parquet")):
        db = duckdb.connect()
        db.execute(f"create view documents as select * from '{files}'")
        found = queries.op8_line_rules(spark, folder)
        columns = sorted(found.columns)
        expected = db.sql(f"select {', '.join(columns)} from ({queries.ORACLES['op8_line_rules']})").fetchall()
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected)
    assert found.where("removed_words > 0 and not kept and not base_failed").count() > 0


def test_line_rules_count_every_document_of_a_footer(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    footer = [line(9) for _ in range(5)]
    docs = [(k, "\n".join([line(60), *footer]), "host") for k in range(1000)]
    found = LineRules(spark.createDataFrame(docs, "doc_id long, text string, source string")).frequent_lines().collect()
    assert {r.line: (r.n_docs, r.n_rows) for r in found} == {document_stats(x)["lines"][0]["line"]: (1000, 1000) for x in footer}


def test_line_rules_limit_does_not_grow_with_the_host(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(k, line(12) + ("\nshared by a few" if k < 20 else ""), "host") for k in range(4300)]
    found = LineRules(spark.createDataFrame(docs, "doc_id long, text string, source string")).frequent_lines().collect()
    assert [(r.line, r.n_docs) for r in found] == [(document_stats("shared by a few")["lines"][0]["line"], 20)]


def test_packing_is_valid_and_tight():
    rng = random.Random(1)
    lengths = [rng.randint(1, 4096) for _ in range(800)]
    placed = packing.pack(lengths)
    used = defaultdict(list)
    for n, (b, at, size) in zip(lengths, placed, strict=True):
        used[b, size].append((at, n))
    for (_, size), items in used.items():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and items[0][0] == 0
        filled = sum(n for _, n in items)
        assert filled <= size and not any(filled <= s < size for s in packing.LENGTHS)
    assert sum(lengths) >= 0.97 * sum(size for _, size in used)


def plain_best_fit(lengths, permitted, overhead):
    """The same rule by looking at every bin and every piece that is left."""
    left, bins, out = sorted(lengths), [], {}  # bins: [room, when it last changed, contents]
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    for turn, k in enumerate(order):
        n = lengths[k]
        left.remove(n)
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            mine = min(fitting, key=lambda b: (b[0], -b[1]))
        else:

            def price(size):
                room, filled, rest = size - n, n, list(left)
                while fits := [x for x in rest if x <= room]:
                    rest.remove(fits[-1])
                    room, filled = room - fits[-1], filled + fits[-1]
                return (size + overhead) / filled, size

            mine = [min((c for c in permitted if c >= n), key=price), 0, []]
            bins.append(mine)
        mine[0], mine[1] = mine[0] - n, turn
        mine[2].append(k)
    for b in bins:
        used = sum(lengths[k] for k in b[2])
        for k in b[2]:
            out[k] = (tuple(b[2]), min(c for c in permitted if c >= used))
    return out


def test_packing_equals_a_plain_search_and_is_near_the_optimum():
    rng = random.Random(11)
    for _ in range(60):
        permitted = rng.choice([(8, 16, 32), (10, 25), (64,)])
        lengths = [rng.randint(1, permitted[-1]) for _ in range(rng.randint(1, 40))]
        placed, members = packing.pack(lengths, permitted, 2), defaultdict(list)
        for k, (b, at, size) in enumerate(placed):
            members[b].append((at, k, size))
        plain = plain_best_fit(lengths, permitted, 2)
        for own in members.values():
            for _, k, size in own:
                assert plain[k] == (tuple(j for _, j, _ in sorted(own)), size)

    def optimum(lengths, permitted):
        best = [10**9]

        def go(k, bins):
            if k == len(lengths):
                best[0] = min(best[0], sum(min(c for c in permitted if c >= b) for b in bins))
                return
            for j in range(len(bins)):
                if bins[j] + lengths[k] <= permitted[-1]:
                    go(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
            go(k + 1, [*bins, lengths[k]])

        go(0, [])
        return best[0]

    ratios = []
    for _ in range(40):
        lengths = [rng.randint(1, 16) for _ in range(7)]
        sizes = {b: size for b, _, size in packing.pack(lengths, (8, 16), 1)}
        ratios.append(sum(sizes.values()) / optimum(lengths, (8, 16)))
    assert max(ratios) <= 1.5 and sum(ratios) / len(ratios) < 1.05


def test_packed_sequences_hold_every_token(spark):
    ids = bpe.encode(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text").persist()
    placed = packing.pack_documents(ids, F.size("ids"))
    own, parts = dict(ids.collect()), defaultdict(list)
    for r in packing.sequences(placed, ids).collect():
        assert len(r.tokens) <= r.capacity and len(r.tokens) == sum(d.length for d in r.documents)
        for d in r.documents:
            parts[d.doc_id].append((d.piece, r.tokens[d.offset : d.offset + d.length]))
    assert {i: [t for _, p in sorted(ps) for t in p] for i, ps in parts.items()} == {i: t for i, t in own.items() if t}
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(100).alias("length")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so small a table would be one task anyway
    tasks = packing.pack_pieces(same).groupBy(F.shiftright("bin_id", 40).alias("task")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 20_000


def test_cross_entropy_query(spark, texts, reference):
    ranks, library = reference
    v, rows = max(ranks.values()) + 1, queries.op3_cross_entropy_difference(spark, SF).collect()
    ids = {i: library.encode_ordinary(t or "") for i, t in texts.items()}
    counts = {k: (Counter(), Counter(), Counter()) for k in (True, False)}
    for r in rows:
        before = v
        for w in ids[r.doc_id]:
            for c, key in zip(counts[r.target], ((before, w), w, before), strict=True):
                c[key] += 1
            before = w
    t, b = (sum(counts[k][1].values()) for k in (True, False))

    def loss(k, total, by, own):
        out, before, (pairs, words, contexts) = 0.0, v, counts[k]
        for w in own:
            one = (words[w] * by + 0.5) / (total * by + 0.5 * v)
            out -= np.log2((pairs[before, w] * by + 4 * one) / (contexts[before] * by + 4))
            before = w
        return out / max(1, len(own))

    for r in rows[:40]:
        assert abs(loss(True, t, 1, ids[r.doc_id]) - loss(False, b, t / b, ids[r.doc_id]) - r.score) < 1e-9


def test_base_rules_against_plain_counts():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c", "a b c", "é", "#", "|", " ", " ", "\n", "\t", "x y"]) for _ in range(rng.randint(0, 60)))
        words = text.encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
        lines, seen, dup = text.split("\n"), set(), 0
        for x in lines:
            if x.encode().split():
                dup += x in seen
                seen.add(x)
        s = document_stats(text)
        assert (s["n_words"], s["n_repeat_words"], s["n_dup_lines"]) == (len(words), len(covered), dup)
        assert s["word_chars"] == sum(len(w.decode()) for w in words) and s["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
