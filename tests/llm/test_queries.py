"""The numbered queries against brute force at the smallest scale."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillspark.llm import queries as registered
from quillspark.llm.encoders import rank_file
from quillspark.llm.simhash import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def found(spark, name):
    return registered.queries()[name](spark, SF).toPandas()


def test_op1_components(spark, docs):
    out = found(spark, "op1_simhash_near_dedup").set_index("doc_id")
    prints = {d: simhash(t) for d, t in docs.items()}
    assert {d: f"{p:016x}" for d, p in prints.items()} == out.fingerprint.to_dict()
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert {d: top(d) for d in docs} == out.component_id.to_dict()


def plain_spans(text):
    """The base patterns by the regular expressions alone."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_op2_base_spans(spark, docs):
    out = found(spark, "op2_personal_data").set_index("doc_id")
    for d, t in docs.items():
        base = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert out.base_sha256[d] == hashlib.sha256(joined.encode()).hexdigest()
        assert (out.n_email[d], out.n_ip[d], out.n_card[d], out.n_phone[d]) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        assert set(filter(None, joined.split(","))) <= set(out.spans[d].split(","))


def test_op3_ids_are_the_library_s(spark, docs):
    out = found(spark, "op3_byte_bpe").set_index("doc_id")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for d, t in docs.items():
        ids = library.encode_ordinary(t)
        assert (out.n_tokens[d], out.ids_sha256[d]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out.decoded_sha256[d] == hashlib.sha256(t.encode()).hexdigest()


def vectors():
    return duckdb.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()


def test_op4_recall(spark):
    out = found(spark, "op4_multiprobe_lsh")
    rows = vectors()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        mine = out[out.query_id == q]
        hits += len(set(mine.vec_id) & set(ids[best]))
        total += 5
        assert np.allclose(mine.score, [score[ids == v][0] for v in mine.vec_id]) and list(mine.sort_values("rank").score) == sorted(mine.score, reverse=True)
    assert hits / total >= 0.9


def test_op5_held_out(spark, docs):
    out = found(spark, "op5_toxicity").set_index("doc_id")
    assert {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs} == out.held_out.to_dict()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_op6_texts(spark):
    out = found(spark, "op6_html_text")
    assert len(out) == duckdb.execute(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchone()[0]
    assert (out.n_chars == out.text.str.len()).all() and not out.text.str.contains(r"<(?:p|div|script)\b").any()
    assert (out.n_chars > 0).mean() > 0.9


def test_op7_and_op9_tokens(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    counts = found(spark, "op7_token_counts").set_index("doc_id")
    assert {d: len(i) for d, i in ids.items()} == counts.n_tokens.to_dict() and {d: len(t.encode()) for d, t in docs.items()} == counts.n_bytes.to_dict()
    packed = found(spark, "op9_best_fit_packing")
    of = defaultdict(list)
    for r in packed.itertuples():
        of[r.doc_id].append(r)
    for d, i in ids.items():
        whole, at = [*i, 0], 0
        for n, r in enumerate(sorted(of[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packed.sequence_id.nunique() <= 1.02 * -(-packed.length.sum() // 2048) + 1


def test_op8_is_exact(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = ["query_id", "rank", "vec_id", "score"]
    want = con.execute(registered.OP8_SQL).df()[columns].sort_values(columns[:2]).values.tolist()
    assert found(spark, "op8_va_file")[columns].sort_values(columns[:2]).values.tolist() == want
