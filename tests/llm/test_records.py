"""Operators 6, 8 and 9: round trips, brute force, and properties of the model."""
import base64
import gzip
import hashlib
import json
import re
import tempfile
from types import SimpleNamespace

import edges
import numpy as np
import pyarrow as pa
import pytest

from attraudit.llm import pseudo_likelihood as lm
from attraudit.llm import secret_scan, warc


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/warc"


BIG = "<p>" + "Wörter\r\n\r\nWARC/1.1\r\n" * 80 + "</p>"
PAGES = [(1, "http://a/x", "short"), (2, "http://a/y", "short"), (3, "http://b/ \r\nX: 1", BIG), (4, "http://b/2", BIG), (5, None, BIG + "!"), (6, "u", None), (None, "http://n", BIG), (9, "http://b/9", BIG), (9, "http://b/9", BIG), (7, "http://c", ""), (8, "http://c", "x" * 999), (10, "http://c", "x" * 999), (11, "http://c", "é" * 500), (12, "http://c", "é" * 500)]


def pages(spark, rows):
    return spark.createDataFrame([r + (1, 2, 3) for r in rows], "page_id long, url string, html string, digest int, bytes int, row int")


def brute_warc(rows):
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        last = max((q for q, _, g in rows if (g or "").encode() == body and q is not None), default=None)
        again = len(body) >= 1000 and last is not None and p != last
        out.append((p or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    got = warc.report(pages(spark, PAGES), scratch()).collect()
    assert sorted([(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute_warc(PAGES)
    assert warc.report(pages(spark, []), scratch()).collect() == []


def test_captures_hold_their_records(spark):
    path = scratch()
    warc.write(pages(spark, PAGES), path)
    records = warc.read_records(spark, path)
    rows = warc.captures(records).collect()
    assert len(rows) == len(PAGES) and records.count() == 3 * len(PAGES)
    for r in rows:
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id == r.capture
        if r.response.type == "response":
            html = next((h or "") for p, _, h in PAGES if p == (int(r.response.page) if r.response.page else None))
            assert bytes(r.response.payload).decode() == html or not html
            assert r.response.intact
    orphans = warc.captures(records.where("type = 'request'")).collect()
    assert len(orphans) == len(PAGES) and all(o.response is None for o in orphans)


def test_archives_of_others():
    one = lambda kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    packed = gzip.compress(one("warcinfo", b"a: b")) + gzip.compress(one("resource", b"\0\r\n\r\nWARC/1.0\r\n"))
    assert [(h["warc-type"], b) for h, b in warc.records_of(packed)] == [("warcinfo", b"a: b"), ("resource", b"\0\r\n\r\nWARC/1.0\r\n")]
    with pytest.raises(ValueError):
        list(warc.records_of(gzip.compress(one("resource", b"abc")[:-6])))


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


RSA = der(0x30, *[der(2, b"\0")] + [der(2, b"\x7f" * 64)] * 8)
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", b"k" * 100))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub": 1}', b"sign" * 8))
SECRETS = [
    "my Password = 'hunter22' and token:abc SECRET: \"x_yz12\" passwd=12345 api-key=zzzzzzzz API_KEY : zzzzzzz",
    "ſecret=abcdefgh toKen=abcdefgh secret=\tabcdefgh", "secret secret: secret:secret=abcdef=g",
    "AKIA" + "Z9" * 8 + " AKIASHORT AKIAAKIA" + "Q" * 14 + " xAKIA" + "0" * 20, "deadbeef" * 3 + " " + "DEADBEEF" * 3 + " " + "a" * 23,
    "key " + RSA.hex() + " end", "key " + base64.b64encode(RSA).decode() + " x", base64.b64encode(PKCS8).decode(), base64.b64encode(RSA[:-3]).decode(),
    "ssh-rsa " + base64.b64encode(SSH).decode(), TOKEN, TOKEN.replace("e", "f", 1), "\U0001f600" * 5 + TOKEN,
    "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(PKCS8).decode() + "-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----", "", "plain words only",
]


def brute_base(text):
    out = []
    for k, (pattern, fits) in enumerate([
        (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]):
        out += [(m.start(), k, f"{secret_scan.KINDS[k]}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if fits(m)]
    return sorted(out)


def test_secrets_equal_brute_force_and_are_confirmed(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(99, None)]
    df = spark.createDataFrame([r + (1, 2) for r in rows], "doc_id long, text string, s int, spans int")
    got = {r.doc_id: r for r in secret_scan.report(df).collect()}
    for i, t in rows:
        base = brute_base(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(b[2] for b in base).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in secret_scan.KINDS[:3]] == [b[2] for b in base]
    more = {i: {s.split(":")[0] for s in got[i].spans.split(",")} - {"", *secret_scan.KINDS[:3]} for i, _ in rows}
    assert {i: k for i, k in more.items() if k} == {5: {"hexkey"}, 6: {"der"}, 7: {"der"}, 9: {"ssh"}, 10: {"jwt"}, 12: {"jwt"}, 13: {"pem"}}
    assert f"jwt:5:{5 + len(TOKEN)}" in got[12].spans
    assert secret_scan.report(df.limit(0)).collect() == []
    assert secret_scan.report(edges.documents(spark)).count() == len(edges.ROWS)


def test_further_key_forms_and_short_tokens():
    def kinds(text):
        return [(k, text[lo:hi]) for k, lo, hi in secret_scan.spans(text) if k not in secret_scan.KINDS[:3]]

    short = "eyJhbGciOiIifQ.e30."
    assert kinds(short) == [("jwt", short)] and kinds(f"a {short} b") == [("jwt", short)]
    sealed = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(0x30)), der(4, b"\7" * 90))
    dsa = der(0x30, der(2, b"\0"), *[der(2, b"\x7f" * 40)] * 5)
    for key in (sealed, dsa):
        assert kinds(base64.b64encode(key).decode()) == [("der", base64.b64encode(key).decode())]
        assert kinds(base64.b64encode(key[:-1]).decode()) == []
    for blob, kind in ((PKCS8, "der"), (RSA, "der"), (SSH, "ssh")):
        for width, end in ((64, "\n"), (76, "\r\n")):
            flat = base64.b64encode(blob).decode()
            wrapped = end.join(flat[k:k + width] for k in range(0, len(flat), width))
            assert kinds(f"see:\n{wrapped}\n\nand more") == [(kind, wrapped)]
            assert kinds(f"see:\n{wrapped[:-9]}\n\nand more") == []
    pad = next(n for n in range(100, 200) if len(base64.b64encode(der(0x30, der(2, b"\0"), *[der(2, b"\x7f" * n)] * 8))) % 64 == 0)
    flat = base64.b64encode(der(0x30, der(2, b"\0"), *[der(2, b"\x7f" * pad)] * 8)).decode()
    wrapped = "\n".join(flat[k:k + 64] for k in range(0, len(flat), 64))
    assert kinds(wrapped + "\nword") == [("der", wrapped)]

    def block(cipher, body):
        return f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{cipher}\n\n{base64.encodebytes(body).decode()}-----END RSA PRIVATE KEY-----"
    good = block("0F" * 16, bytes(range(160)))
    assert kinds(good) == [("pem", good)] and kinds(block("0F" * 16, bytes(155))) == [] and kinds(block("", bytes(160))) == []


def test_model_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(1)
    flat = lm.initial().astype("f8") + rng.normal(0, 0.05, lm.SIZE)
    p = lm.layers(flat)
    ctx = rng.integers(0, lm.IDS + 1, (1, 2 * lm.SIDE))
    every = lm.forward(p, np.repeat(ctx, lm.IDS, 0), np.arange(lm.IDS))[0]
    assert abs(np.exp(every).sum() - 1) < 1e-9
    ctx, want = rng.integers(0, lm.IDS + 1, (9, 2 * lm.SIDE)), rng.integers(0, lm.IDS, 9)
    after = flat.copy()
    lm.step(lm.layers(after), ctx, want, 1.0)
    moved = lm.layers(flat - after)
    assert not moved["id_b"].any()  # counted, not trained
    for name in set(lm.SHAPES) - {"id_b"}:
        scale = 3.0 if name == "embed" else 1.0  # the square root of nine examples
        at = np.unravel_index(np.abs(moved[name]).argmax(), lm.SHAPES[name])
        old = p[name][at]
        loss = []
        for e in (1e-5, -1e-5):
            p[name][at] = old + e
            loss.append(-lm.forward(p, ctx, want)[0].mean())
        p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-5 * scale - moved[name][at]) < 1e-6


def test_scores_are_sums_over_all_tokens(spark):
    docs = lm.tokens_of(edges.documents(spark))
    weights = lm.train(docs, rounds=1)
    p, ids = lm.layers(weights), lm.Ids()
    got = lm.score(docs, weights).collect()
    assert len(got) == len(edges.ROWS)
    text = {r[0]: r[1] for r in edges.ROWS if r[0] != 1}
    for r in got:
        if r.doc_id not in text:
            continue
        t = ids.text(text[r.doc_id] or "")
        want = sum(float(lm.forward(p, lm.contexts(t, np.array([k])), t[k:k + 1])[0][0]) for k in range(0, len(t)))
        assert r.n_tokens == len(t) and abs(r.score - want) < 1e-3 * max(1, len(t))
        assert (r.mean_log_prob is None) == (len(t) == 0)
    assert lm.report(edges.documents(spark, [])).collect() == []


def test_training_beats_the_start_on_unseen_documents(spark):
    docs = lm.tokens_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4, "doc_id"))
    weights = lm.train(docs.where("doc_id % 5 <> 0"))
    mean = lambda w: lm.score(docs.where("doc_id % 5 = 0"), w).selectExpr("sum(score) / sum(n_tokens)").first()[0]
    assert mean(weights) > mean(lm.initial()) + 0.1


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_token_is_a_target_of_training_once(monkeypatch, rounds):
    docs = [np.arange(a, a + n, dtype="<u2") for a, n in ((0, 1), (1, 1), (10, 7), (100, 3000), (3200, 2))]
    got = []
    monkeypatch.setattr(lm, "_steps", lambda p, ctx, target, rate: got.extend(np.concatenate(target).tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in docs], pa.binary())], ["ids"])
    n = 0
    for k in range(rounds):
        n += sum(b.column(2)[0].as_py() for b in lm._walk(SimpleNamespace(value=lm.initial()), 0.5, k, rounds)(iter([batch])))
    assert sorted(got) == np.concatenate(docs).tolist() and n == len(got)


def plain_step(p, ctx, target, rate):
    """The same descent by the book: one example at a time, in double precision."""
    moves = {k: np.zeros_like(v) for k, v in p.items()}
    for around, t in zip(ctx, target):
        c, j = divmod(int(t), lm.INNER)
        x = np.concatenate([p["embed"][a] for a in around])
        h = np.tanh(x @ p["w"] + p["b"])
        g = np.tanh(h + p["given"][c])
        dc, dj = h @ p["cls"] + p["cls_b"], g @ p["inner"] + p["inner_b"] + p["id_b"][c]
        dc, dj = (np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z in (dc, dj))
        dc[c] -= 1
        dj[j] -= 1
        dg = (p["inner"] @ dj) * (1 - g * g)
        dh = (p["cls"] @ dc + dg) * (1 - h * h)
        for k, move in (("inner", np.outer(g, dj)), ("inner_b", dj), ("cls", np.outer(h, dc)), ("cls_b", dc), ("w", np.outer(x, dh)), ("b", dh)):
            moves[k] += move
        moves["given"][c] += dg
        for a, d in zip(around, (p["w"] @ dh).reshape(-1, lm.EMBED)):
            moves["embed"][a] += d * np.sqrt(len(target))
    for k in p:
        p[k] -= rate / len(target) * moves[k]


def test_a_task_trains_like_plain_descent_in_whole_steps():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, n).astype("<u8") % lm.IDS for n in (2500, 1, 2300, 700)]
    batch = pa.RecordBatch.from_arrays([pa.array([d.astype("<u2").tobytes() for d in docs], pa.binary())], ["ids"])
    got, = lm._walk(SimpleNamespace(value=lm.initial()), 0.5, 0, 1)(iter([batch]))
    want = lm.initial().astype("f8")
    ctx, target = np.concatenate([lm.contexts(d, np.arange(len(d))) for d in docs]), np.concatenate(docs)
    for k in range(0, len(target), lm.STEP):
        plain_step(lm.layers(want), ctx[k:k + lm.STEP], target[k:k + lm.STEP], 0.5)
    moved = np.abs(want - lm.initial()).max()
    assert moved > 0.1 and np.abs(got.column("total").to_numpy() / len(target) - want).max() < 1e-4 * moved


@pytest.mark.parametrize("size", [150.0, -150.0, 1e4])
def test_logits_beyond_the_range_of_floats_keep_their_probabilities(size):
    flat = lm.initial()
    p = lm.layers(flat)
    p["cls_b"][:] += size
    p["inner_b"][::2] += size
    ctx, want = np.arange(4 * 32).reshape(32, 4), np.arange(0, lm.IDS, lm.IDS // 32)
    exact = lm.forward(lm.layers(flat.astype("f8")), ctx, want)[0]
    got = lm.forward(p, ctx, want)[0]
    assert np.isfinite(got).all() and np.abs(got - exact).max() < 1e-6 * abs(size) + 1e-4


def test_word_ids_are_hashes_of_lowered_words():
    from xxhash import xxh64_intdigest

    words = ["Ab", "ab", "\u00c4b", "\u00e4b", "x" * 300, "a\u00a0b", "\x1c"]
    got = lm.Ids().text("\t " + " \n\x0b".join(words) + "\x0c")
    assert got.tolist() == [xxh64_intdigest(w.encode().lower(), 7) % lm.IDS for w in words] and lm.Ids().text(" ").tolist() == []
