"""Alignment of tokenizers, the Merkle manifest and binary token files: edge cases and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import alignment, merkle, spaced, token_output

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, place long, block binary, root string, pairs int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "same"), (4, "same"), (5, LONG), (6, "\x00 é\n漢 <|endoftext|> </s> <0x41>"), (7, "same"), (8, "a ▁b"), (9, "  two  spaces \n"), (-12, "before"), (10, "😀" * 50)]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, ("s", None, "", "é", "t")[n % 5], "en" if n % 3 else None, None if t is None else len(t), 1, b"", "r", 2) for n, (i, t) in enumerate(rows)], SCHEMA)


def texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "　", "漢", "😀", ".", ", ", "1", "ing", "'s", "\x1c", "<|endoftext|>", "\x85"]
    return [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))) for k in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- alignment -----------------------------------------------------------------------


def aligned_slowly(rows):
    """Whole texts by the libraries, overlaps by comparing every token with every other."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    chars = {c: b for b, c in spaced.char_of_byte().items()}
    docs, counts = [], Counter()
    for i, t in rows:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(chars[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = b" " + (t or "").encode()
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((i, [], [], [], [], ""))
            continue
        ends = lambda parts: np.cumsum([0, *map(len, parts)]).tolist()
        ea, eb = ends(bytes_a), ends(bytes_b)
        links = []
        for x in range(len(a)):
            near = range(len(b)) if len(b) < 300 else range(max(0, np.searchsorted(eb, ea[x]) - 3), min(len(b), np.searchsorted(eb, ea[x + 1]) + 3))
            links += [(a[x], b[y]) for y in near if max(ea[x], eb[y]) < min(ea[x + 1], eb[y + 1])]
        groups, la, lb = [], 0, 0
        for cut in sorted(set(ea[1:]) & set(eb[1:])):
            na, nb = ea.index(cut), eb.index(cut)
            groups.append(",".join(map(str, a[la:na])) + "|" + ",".join(map(str, b[lb:nb])))
            la, lb = na, nb
        counts.update(links)
        docs.append((i, a, b, groups, links, sha(";".join(groups))))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter((i, len(a), len(b), len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), h) for i, a, b, g, k, h in docs)


def test_alignment_by_brute_force(spark, monkeypatch):
    rows = [(i, t if t != LONG else LONG[:9000]) for i, t in EDGES] + texts(250, 5)
    expect = aligned_slowly(rows)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = lambda: Counter(tuple(r[x] for x in names) for r in alignment.align(frame(spark, rows).repartition(3), A, B).collect())
    assert got() == expect
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 700)  # many blocks, tables that are emptied again and again
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 20)
    assert got() == expect
    assert alignment.align(frame(spark, []), A, B).count() == 0
    zeros = {r.doc_id: r for r in alignment.align(frame(spark, EDGES[:2] + [(8, "a ▁b")]), A, B).collect()}
    assert all((r.n_a, r.n_b, r.n_links, r.groups_sha256) == (0, 0, 0, "") for r in zeros.values()) and len(zeros) == 3


def test_wide_gaps_and_counts(spark):
    """A document that links one pair more than 255 times."""
    rows = [(1, "the " * 400 + "end"), (2, "the")]
    assert Counter(tuple(r) for r in alignment.align(frame(spark, rows), A, B).collect()) == aligned_slowly(rows)


def test_chunks_are_aligned_together_and_common_ones_once(monkeypatch):
    """With a table that starts anew again and again: results stay, and what is met in each portion is not aligned again."""
    with open(A, "rb") as a, open(B, "rb") as b:
        files = a.read(), b.read()
    one, many = alignment.Aligner(*files), alignment.Aligner(*files)
    own = ["", "\x00", "a ▁b", "▁", "é\n漢", "<0x41>", "don't.\nStop", "x" * 5000, "　", *(t for _, t in texts(300, 8))]
    assert many.align(own) == [one.align([x])[0] for x in own]
    assert None in many.align(own) and many.align(["", ""]) == [None, None]
    seen, align = Counter(), many.align
    monkeypatch.setattr(many, "align", lambda chunks: seen.update(chunks) or align(chunks))
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 40)
    for k in range(30):
        portion = [f"the house of n{k}x{j} and " + x for j, x in enumerate(own[:9] + own[9 + 10 * k : 19 + 10 * k])]
        assert many.texts(portion) == [one.align([x])[0] or (b"", b"") for x in portion]
        assert len(many) + len(many.before) < 400 and len(many.odd) < 400
    assert [seen[x] for x in ("house", "of", "and", "n0x0")] == [1, 1, 1, 1]


# --- the manifest --------------------------------------------------------------------


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest_slowly(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict, by recursion over lists."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for n, (named, i, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            tampered = named and zlib.crc32(str(i).encode()) % 5 == 0
            digest, proof = leaf(r, low(r["text"])) if tampered else own, ""
            for levels, at in ((trees[s], n), (top, k)):
                for nodes in levels[:-1]:
                    run = nodes[at - at % 16 : at - at % 16 + 16]
                    proof += "".join(x for j, x in enumerate(run) if j != at % 16)
                    digest = sha("".join(digest if j == at % 16 else x for j, x in enumerate(run)))
                    at //= 16
            out[r["doc_id"], own, trees[s][-1][0], top[-1][0], sha(proof), digest, digest == top[-1][0]] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("height, top", [(4, 4096), (1, 4096), (1, 3), (2, 5)])
def test_manifest_by_brute_force(spark, monkeypatch, height, top):
    """Small blocks and a small top tree take the rounds that large inputs take."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "TOP_NODES", top)
    rng = random.Random(7)
    rows = [(i, t, None, None, None) for i, t in EDGES]
    rows += [(1000 + k, f"Text {k % 90} OF Many", rng.choice(["big", "big", "big", None, "", *map(str, range(20))]), "EN", k) for k in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "'x' AS leaf", "1 AS place", "2 AS n", "'y' AS digest")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.manifest(docs.repartition(3)).collect())
    expect = manifest_slowly([r.asDict() for r in docs.collect()])
    assert got == expect
    assert 0 < sum(n for k, n in got.items() if not k[-1]) < len(rows)


def test_manifest_of_few(spark):
    docs = frame(spark, [])
    assert merkle.manifest(docs).count() == 0
    one = merkle.manifest(frame(spark, [(3, "Only")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("") and one.path == []


# --- token files ---------------------------------------------------------------------


@pytest.mark.parametrize("n, last", [(0, 0), (1, 0), (1, 2**63), (7, 0), (1000, 90), (1000, 10**6), (3000, 2**62), (70, 2**40)])
def test_elias_fano(n, last):
    values = np.random.default_rng(n).integers(0, last + 1, n, dtype=np.uint64)
    values[n // 3 : n // 2] = values[n // 3] if n else 0  # a run of equal ones
    values.sort()
    held = token_output.EliasFano.of(values)
    data = held.to_bytes()
    back, end = token_output.EliasFano.read(b"12345678" + data, 8)
    assert end == 8 + len(data) and (back.select(np.arange(n)) == values).all()
    assert (back.select(np.arange(n)[::-7]) == values[::-7]).all()
    if n >= 1000:
        assert len(data) * 8 / n < 2 + np.log2(max(1, int(values[-1]) / n)) + 1.6


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_token_files_by_brute_force(spark, monkeypatch, tmp_path, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK_TOKENS", block)
    monkeypatch.setattr(token_output, "MEMO_ENTRIES", 1 << 20 if block > 50 else 9)
    rows = EDGES + texts(300, 9)
    token_output.write(frame(spark, rows).repartition(3), A, f"{tmp_path}/ids")
    got = token_output.read(spark, f"{tmp_path}/ids", with_ids=True).collect()
    tok = Tokenizer.from_file(A)
    expect = Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expect
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_documents_and_odd_files(spark, tmp_path):
    assert token_output.write_and_read(frame(spark, []), A).count() == 0
    with pytest.raises(ValueError, match="no block"):
        list(token_output.unpack(b"x" * 64))
