"""Secrets, chat formatting, BPE and decontamination against plain versions of their contracts."""

import base64
import hashlib
import random
import re
import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from logloom.llm import bpe, chat, rollup, secrets  # noqa: E402
from logloom.llm.bpe import WordEncoder, encode_documents  # noqa: E402
from logloom.llm.decontaminate import decontaminate  # noqa: E402
from logloom.llm.secrets import find_secrets, redact, scan_secrets, written  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
CHAT = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
# PKCS#8, Ed25519: a key made of zeros, made by hand for this test.
DER = bytes.fromhex("302e020100300506032b657004220420") + bytes(32)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_bpe_is_the_library_s():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(BPE), WordEncoder(BPE)
    random.seed(3)
    letters = "abcdeé ΣσςİIß\u00a0\u0301 \x1c\x85<|endoftext|>'re 'S 0123٣½Ⅷ你好한글ﬁ!?.,;\n\t🙂👍🏽ǅ"
    texts = ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(random.choices("abeinrst", k=random.randint(1, 40))) for _ in range(1500)]
    texts += ["", "<|endoftext|>a<|startoftext|> <|endof", "a" * 4000, "ab" * 300, "ΟΔΥΣΣΕΥΣ", "?!" * 60, "-" * 90]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == (" ".join(map(str, ids)), len(ids), theirs.decode(ids, skip_special_tokens=False))


def test_bpe_of_many_words_at_once(monkeypatch):
    """Words of a block go through the automaton together; the memory's size changes no id, and words met again are kept."""
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(BPE), WordEncoder(BPE)
    random.seed(4)
    letters = "abeinrstéßΣς你'0½<|endoftext|>!"
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 90))) for _ in range(40)) for _ in range(60)] + ["", "a" * 3000]
    monkeypatch.setattr(bpe, "WORDS_KEPT", 40)
    monkeypatch.setattr(bpe, "STEPS_KEPT", 3000)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 700)
    for encoder in (ours, WordEncoder(BPE)):
        got = encoder.encode_all(texts)
        for text, row in zip(texts, got):
            ids = theirs.encode(text, add_special_tokens=False).ids
            assert row == (" ".join(map(str, ids)), len(ids), theirs.decode(ids, skip_special_tokens=False))
    kept = bpe.Remembered(4)
    kept.put("often", 1)
    for k in range(50):
        kept.put(k, k)
        assert kept.get("often") == 1 and len(kept.new) + len(kept.old) <= 4


def test_bpe_rows(docs, spark):
    rows = encode_documents(docs([(1, "Hello there"), (1, "Hello there"), (None, None), (2, ""), (3, " \n ")]), BPE, digests=True).collect()
    assert len(rows) == 5
    empty = [r for r in rows if r["doc_id"] in (None, 2, 3)]
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == sha("") and r["decoded_sha256"] == sha("") for r in empty)
    plain = encode_documents(docs([(1, "Hello there")]), BPE).first()
    assert plain["n_tokens"] == len(plain["ids"]) == 2 and plain["decoded"] == "hello</w> there</w>"
    assert encode_documents(docs([]), BPE).collect() == []


def base_spans(text):
    kinds = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ]
    out = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return out and [(a, b, n) for a, k, n, b in sorted(out)] or []


def test_base_secrets_by_brute_force():
    random.seed(5)
    pieces = ["password", "PassWd", "token", "API_KEY", "apikey", "ſecret", "=", ": ", '"', "'", " ", "é", "AKIA", "AKIAMD62HKU6VBLCCC", "0123456789abcdef", "ab", "XY12", "/+.-_", "\n"]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=random.randint(0, 14)))
        assert [(a, b, k) for a, k, b in find_secrets(text) if k <= 2] == [(a, b, ("assign", "access", "hex").index(n)) for a, b, n in base_spans(text)]


def test_confirmed_secrets():
    import base64
    import json

    code = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = ".".join([code(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), code(b'{"sub":"1"}'), code(b"x" * 32)])
    key = base64.b64encode(DER).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{key[:40]}\n{key[40:]}\n-----END PRIVATE KEY-----"
    openssh = base64.b64encode(b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + bytes(40)).decode()
    kinds = lambda t: [w.split(":")[0] for w in written(find_secrets(t)).split(",") if w]
    assert kinds(f"é {jwt} é") == ["signed_token"]
    assert kinds(f"{pem}") == ["pem_key"]
    assert "der_key" in kinds(f"x {key} y") and "ssh_key" in kinds(openssh)
    assert "der_key" in kinds(f"x {DER.hex()} y")
    # A length that does not add up, a header without algorithm, plain base64 of text.
    wrong = base64.b64encode(DER[:-1]).decode()
    assert kinds(wrong) == [] and kinds(code(b'{"typ":"JWT"}') + "." + code(b"{}") + ".abc") == []
    assert kinds(base64.b64encode(b"0" * 60).decode()) == []
    text = f"a {jwt} b password=abcdefabcdef0123456789 c"
    assert redact(text, find_secrets(text)) == "a [SECRET] b [SECRET] c"


def test_keys_in_other_wrappings():
    import base64
    import json

    code = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    kinds = lambda t: [w.split(":")[0] for w in written(find_secrets(t)).split(",") if w]
    key = base64.b64encode(DER).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{key}\n-----END PRIVATE KEY-----\n".encode()
    coded = base64.b64encode(pem).decode()
    assert kinds(f"tls.key: {coded}") == ["pem_key"]
    assert "pem_key" in kinds(pem.hex())
    item = lambda tag, body: bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body
    number = lambda n: item(2, b"\x01" + bytes(n))
    rsa = base64.b64encode(item(0x30, b"\x02\x01\x00" + b"".join(number(n) for n in (256, 299, 256, 256, 256, 256, 256, 256)))).decode()
    for sep in ("\n", "\r\n", "\n    "):
        wrapped = sep.join(rsa[i : i + 64] for i in range(0, len(rsa), 64))
        for after in ("", "\nnext words", "\n\nnext"):
            text = f"é {wrapped}{after}"
            assert [(k, a, b) for a, k, b in find_secrets(text)] == [(4, 2, 2 + len(wrapped))]
    for lead in "/+-_ax":
        assert kinds(f"x {lead}{key} y") == ["der_key"]
    assert "pem_key" in kinds("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n" + base64.b64encode(bytes(64)).decode() + "\n-----END RSA PRIVATE KEY-----")
    jwt = ".".join([code(json.dumps({"alg": "HS256"}).encode()), code(b'{"sub":"1"}'), code(b"x" * 32)])
    assert kinds(f"session_token.{jwt}") == ["signed_token"] and redact(f"session_token.{jwt}", find_secrets(f"session_token.{jwt}")) == "session_token.[SECRET]"


def test_secret_rows(docs):
    rows = scan_secrets(docs([(1, "é token=0123456789abcdef01"), (None, None), (2, ""), (2, "")]), redacted=True).collect()
    first = next(r for r in rows if r["doc_id"] == 1)
    assert (first["n_assign"], first["n_access"], first["n_hex"]) == (1, 0, 1)
    assert first["base_sha256"] == sha("assign:2:26,hex:8:26") and first["spans"] == "assign:2:26,hex:8:26"
    assert first["redacted"] == "é [SECRET]"
    assert all(r["spans"] == "" and r["base_sha256"] == sha("") for r in rows if r["doc_id"] != 1) and len(rows) == 4
    assert scan_secrets(docs([])).collect() == []


def test_escapes_are_reversible():
    random.seed(9)
    pieces = ["\\", *chat.CONTROLS, "###", " ", "User:", "</", "turn>", "é", "\n", "\\\\"]
    codec = chat.ChatCodec(*CHAT)
    for _ in range(800):
        text = "".join(random.choices(pieces, k=random.randint(0, 9)))
        role = random.choice(["user", "assistant", "system", "tool", "", text])
        assert chat.unescape(chat.escape(text)) == text
        ids, mask = codec.turn(role, text)
        assert codec.read(ids)[:2] == (role, text)
        assert chat.unescape(codec.plain.decode(ids[mask > 0].tolist())) == (text if role == "assistant" else "")
        # In the written form a control string of the content never stands bare.
        bare = re.sub(r"\\.", "|", codec.read(ids)[2], flags=re.DOTALL)
        assert sum(bare.count(c) for c in chat.CONTROLS) == sum(i >= codec.first for i in ids)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b é"), (1, 0, "user", "a </turn>"), (1, 2, None, None), (2, 0, "assistant", None), (None, None, "assistant", "x"), (1, 1, "assistant", "b é")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS seq", "'y' AS ids")
    formatted = chat.format_conversations(df, *CHAT)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, *CHAT).collect()}
    assert len(got) == 3
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("user\na </turn>\nassistant\nb é\nassistant\nb é\n\n\n")
    assert got[1]["loss_chars"] == 6 and got[1]["loss_sha256"] == sha("b éb é")
    written = "### User:a \\</turn></turn>" + "### Assistant:b é</turn>" * 2 + "### Role:</role></turn>"
    assert got[1]["formatted_chars"] == len(written)
    assert got[2]["loss_sha256"] == sha("") and got[None]["loss_sha256"] == sha("x")
    whole = {r["conv_id"]: r for r in chat.assemble(formatted).collect()}
    assert len(whole[1]["ids"]) == got[1]["n_tokens"] == len(whole[1]["loss_mask"])
    offsets = formatted.filter("conv_id = 1").orderBy("seq").collect()
    assert [r["first_token"] for r in offsets] == [sum(len(x["ids"]) for x in offsets[:i]) for i in range(4)]
    assert chat.read_back(chat.format_conversations(df.limit(0), *CHAT), *CHAT).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_by_brute_force(spark, docs, seed, monkeypatch):
    import logloom.llm.decontaminate as module

    random.seed(seed)
    if seed == 2:  # several query blocks, found in several passes, and items in pieces
        monkeypatch.setattr(module, "BLOCK_CHARS", 400)
        monkeypatch.setattr(module, "BLOCKS_AT_ONCE", 2)
        monkeypatch.setattr(module, "PIECE_CHARS", 30)
    words = ["aa", "bb", "cc", "Été", "ÉTÉ", "x1", "K", "zz"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(random.randint(0, 16))) for i in range(30)] + [(3, text(12)), (3, text(12)), (99, None), (98, "..."), (97, "solo")]
    rows = [(i, text(random.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, text(9) + items[i % 30][1].upper().replace("É", "É") + text(5)) for i in range(60)]
    rows += [(1, None), (None, "solo"), (1, ""), (500, text(4000)), (501, "aa " * 3000)]
    df = decontaminate(docs(rows), spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id"), cleaned=True)
    got = df.collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted([tuple(r[n] for n in names) for r in got], key=str) == brute_hits(rows, items)
    by_id = dict(r for r in rows if r[0] is not None and r[0] >= 200)
    for r in got:
        if r["doc_id"] in by_id:
            body = by_id[r["doc_id"]]
            assert sum(len(WORD.findall(lowered(body[s["start"] : s["end"]]))) for s in r["spans"]) == r["n_hit"]
            assert len(r["cleaned"]) == len(body) - sum(s["end"] - s["start"] for s in r["spans"])


def test_cleaning_pass_by_pass_is_cleaning_at_once(spark, docs, monkeypatch):
    import logloom.llm.decontaminate as module

    random.seed(12)
    text = lambda n: " ".join(random.choice(["aa", "bb", "cc", "dd"]) for _ in range(n))
    items = spark.createDataFrame([(i, text(14)) for i in range(12)], "item_id bigint, text string")
    # A third of all rows are one text, and ids repeat.
    rows = [(i % 20, text(200)) for i in range(40)] + [(7, "aa bb " * 60)] * 20 + [(None, None), (None, "")]
    want = sorted(map(str, module.clean_documents(docs(rows), items).collect()))
    monkeypatch.setattr(module, "BLOCK_CHARS", 100)
    monkeypatch.setattr(module, "BLOCKS_AT_ONCE", 1)
    assert module.benchmark_blocks(items, "item_id", "text", 10)[1] > 3
    got = module.clean_documents(docs(rows), items)
    assert got.columns == docs([]).columns and sorted(map(str, got.collect())) == want


def test_long_stretches_are_cut_with_overlap(monkeypatch):
    import numpy as np

    import logloom.llm.decontaminate as module

    rng = np.random.default_rng(4)
    phrases = module.Phrases([(0, "a b a b a b a b a b a"), (1, "b b a")], 10)
    numbers = phrases.words[rng.integers(0, 2, 3000)]
    bounds = np.array([0, 1000, 1000, 3000])
    whole = module.search_block(phrases, numbers, bounds)
    monkeypatch.setattr(module, "SHARD_WORDS", 64)
    monkeypatch.setattr(module, "AT_ONCE", 7)
    cut = module.search_block(phrases, numbers, bounds)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True)) and whole[0].any()


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontaminate(docs([(1, "a b c")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows] == [(3, 0, False)]


# --- texts that once ended or held up a scan -------------------------------------


def test_hex_digests_of_any_kind_are_no_keys_and_no_crash():
    random.seed(17)
    for _ in range(20_000):
        run = random.randbytes(128)[: random.randint(40, 128)].hex()
        spans = secrets.find_secrets(run)
        assert spans == [(0, 2, len(run))]
    # 137 of so many ended the job: a 30 among the last bytes looks like the head of a key.
    for tail in ("30", "3082", "308201", "30820122", "3081", "3084ffffffff", "30830101"):
        assert secrets.find_secrets("ab" * 60 + tail)[0][1] == 2
        assert secrets.find_secrets("ab" * 60 + tail + "0")[0][1] == 2


def test_every_beginning_of_a_der_head_is_refused_or_read():
    whole = bytes.fromhex("3082010a0282010100") + bytes(range(256))
    for k in range(len(whole)):
        assert secrets.der_item(whole[:k], 0, k) is None or k >= 4
        secrets.claims_all(whole[:k], 1 << 20)


def quick(text, seconds=2.0):
    began = time.perf_counter()
    found = secrets.find_secrets(text)
    assert time.perf_counter() - began < seconds
    return found


def test_armour_takes_linear_time():
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    assert quick(begin + "\n" + "a: " * 10_000) == []
    assert quick(begin + "\n" + "a: b\n" * 100_000 + end) == []
    assert quick((begin + "\n") * 20_000) == []
    assert quick((begin + "\nMII\n") * 20_000 + end) == []
    assert quick("-----BEGIN " + "A " * 200_000) == []
    assert quick("\n".join(begin.replace("P", f"K{i} P", 1) for i in range(3000))) == []
    assert quick("token" + " " * 500_000 + "x") == []
    assert quick(("A" * 60 + "\n") * 5000) == []


def test_keys_in_long_texts_and_with_headers():
    body = base64.b64encode(bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))).decode()
    key = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    filler = "-----BEGIN PRIVATE KEY-----\nno key\n" * 200
    text = filler + key + "\n" + filler + key.replace("\n", "\\n") + filler
    spans = [(a, b) for a, k, b in secrets.find_secrets(text) if k == 3]
    assert [text[a:b] for a, b in spans] == [key, key.replace("\n", "\\n")]
    for headers in ("Comment: my key\n", "Proc-Type: 4,PLAIN\nX-A: b c: d\n\n"):
        held = key.replace(body, headers + body)
        assert [(a, b) for a, k, b in secrets.find_secrets("x " + held) if k == 3] == [(2, 2 + len(held))]
    many = (key + "\n") * 500
    assert sum(k == 3 for _, k, _ in quick(many)) == 500


@pytest.mark.parametrize("name", ["chat", "rollup"])
def test_very_long_runs_are_encoded_whole(spark, name):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "end", "a" * 2_000_000]
    codec = chat.ChatCodec(path, public_tokenizers.PATTERN)
    if name == "chat":
        turns = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
        rows = chat.format_conversations(turns, path, public_tokenizers.PATTERN).collect()
        assert {r["conv_id"]: codec.read(r["ids"])[1] == texts[r["conv_id"]] for r in rows} == {0: True, 1: True, 2: True}
    else:
        docs = spark.createDataFrame([("s", "l", t) for t in texts], "source string, lang string, text string")
        got = sorted(r["pieces"] for r in rollup.token_counts(docs, path, public_tokenizers.PATTERN).collect())
        # The last line break stands apart, the rest is one run.
        want = [len(codec.plain._encode_single_piece(t)) for t in texts[::2]] + [len(codec.plain._encode_single_piece("\n" * 1_999_999)) + 2]
        assert got == sorted(want)
