"""Chat formatting and tokenizer alignment against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from cases import SCHEMA, empty, frame, prose, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposcope.llm import align as AL
from reposcope.llm import chat_format as CF

TALKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()),
                      *(T.StructField(n, T.StringType()) for n in ("said", "segments", "raw", "path", "state", "valid"))])


def talks():
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<s>", " </s>", "  ", "[INST", "<", "<<SYS>>\n", "\\<turn>\\", "x" * 50_000, "漢字 été 🙂", "",
            "<|im_start|>user\n", "<|im_end|>", "</role>", None, "a\n\nb\x0b", "<<</SYS>>>"]
    rng = random.Random(3)
    out = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 9])
        for t in range(n):
            role = rng.choice(["system", "user", "assistant", "tool", "", None, "<turn>", "user\\"]) if c % 3 else ["user", "assistant"][t % 2]
            out.append((c - 5, t, role, rng.choice(hard) if rng.random() < 0.7 else prose(rng, 6)))
    out += [(900, None, "user", "null turn"), (900, 0, "assistant", "after it"), (None, 1, "user", "no id"),
            (901, 3, "user", "twice"), (901, 3, "user", "twice"), (902, 1, "system", "s"), (902, 2, "user", "q"), (902, 3, "assistant", "a")]
    return [(*r, *"uvwxyz") for r in out]


def reference(data, t):
    by = {}
    for c, turn, role, text, *_ in data:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    moves = {(v.state, v.role): v for v in t.moves}
    out = {}
    for c, said in by.items():
        state, strays, loss, turns = t.start, [], "", ""
        for i, (_, role, text) in enumerate(sorted(said)):
            v = moves.get((state, role))
            if v is None:
                strays.append(i)
            state = v.then if v else t.resume.get(role, state)
            loss += text if (v.loss if v else role in t.learned) else ""
            turns += f"{role}\n{text}\n"
        out[c] = (len(said), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                  not strays, strays[0] if strays else None)
    return out


@pytest.mark.parametrize("template", [CF.INSTRUCT, CF.MARKED])
def test_chat_round_trip(spark, template):
    data = talks()
    df = spark.createDataFrame(data, TALKS).repartition(5)
    got = {r["conv_id"]: r for r in CF.chat_digest(df, template).collect()}
    want = reference(data, template)
    assert set(got) == set(want)
    for c, w in want.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["first_stray"]) == w, c
    made = CF.chat_format(df, template)
    for r in made.select("segments", CF.formatted(F.col("segments")).alias("text")).collect():
        assert r["text"] == "".join(s["text"] for s in r["segments"])
        for s in r["segments"][1::3]:  # no control string survives in a text
            assert not any(m in s["text"] for m in template.marks)
    assert CF.chat_digest(df.limit(0), template).collect() == []


def test_chat_example_and_bad_templates(spark):
    data = [(1, 0, "system", "s", *"uvwxyz"), (1, 1, "user", "q [INST]", *"uvwxyz"), (1, 2, "assistant", "a\\", *"uvwxyz"), (1, 3, "assistant", "b", *"uvwxyz")]
    row = CF.chat_format(spark.createDataFrame(data, TALKS)).select("*", CF.formatted(F.col("segments")).alias("text")).first()
    assert row["text"] == "<s><<SYS>>\ns\n<</SYS>>\n\n[INST] q [\\INST] [/INST] a\\\\ </s><turn>assistant</role>b</turn>"
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["a\\\\", "b"] and (row["valid"], row["first_stray"]) == (False, 3)
    with pytest.raises(ValueError):
        CF.ChatTemplate((CF.Move("start", "user", "a", "<s>", "</s>"), CF.Move("a", "bot", "start", "<s>", "</s>")), ("<s>", "</s>"))
    with pytest.raises(ValueError):  # a text's last character and the mark would make up a control string
        CF.ChatTemplate((CF.Move("start", "user", "start", "<s>", ">end"),), ("<s>", "end>", "->", ">end"))


def test_chat_probe(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", *"uvwxyz")], TALKS)
    got = {r["conv_id"]: r for r in CF.chat_digest(CF.with_probe(df)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-7]["valid"]
    plan = CF.chat_digest(CF.with_probe(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def aligned(texts):
    """By the definition: cut points where both end, all overlapping pairs, corpus-wide counts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = AL._byte_of_char()
    made = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        made.append((ids_a, ids_b, *spans))
    links = [[(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]] for _, _, sa, sb in made]
    count = Counter((made[k][0][i], made[k][1][j]) for k, own in enumerate(links) for i, j in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (ids_a, ids_b, sa, sb), own in zip(made, links):
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s in zip(ids_a, sa) if lo < s[1] <= cut) + "|" + ",".join(str(i) for i, s in zip(ids_b, sb) if lo < s[1] <= cut))
            lo = cut
        ns = [count[ids_a[i], ids_b[j]] for i, j in own]
        out.append((len(ids_a), len(ids_b), len(groups), len(own), sum(n == most[ids_b[j]] for n, (i, j) in zip(ns, own)), sum(ns),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_against_brute_force(spark):
    rng = random.Random(8)
    data = [r for r in rows() if len(r[1] or "") < 4000]
    special = ["<|endoftext|> a</s>b<s> <unk>", "▁marks ▁ in", "tab\tnew\nline  two", "a\x00b", "🙂🙃 ﷽ ﬁ é é", "<0x41> <0xFF>", " lead", "trail ", "　wide ", "12345 3.14's we'll",
               "한국어 ไทย العربية", " x", "x" * 300, "ab" * 150 + " " + "\n" * 20, "�", "\r\n\r\n", "a  b   c"]
    data += [(5000 + i, t, None, None, None, "s", "t", "u") for i, t in enumerate(special)]
    data += [(5200 + i, "".join(rng.choice("ab é漢\n🙂'1,▁") for _ in range(60)), None, None, None, "s", "t", "u") for i in range(40)]
    want = sorted(zip([r[0] if r[0] is not None else -10**9 for r in data], aligned([r[1] or "" for r in data])))
    got = AL.alignment_digest(frame(spark, data, 5)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -10**9, tuple(r[c] for c in COLUMNS)) for r in got) == want
    by_id = {r["doc_id"]: r for r in AL.alignments(frame(spark, data, 2)).collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None and r["n_a"]:
            x, text, lo = by_id[r["doc_id"]], [], (0, 0)
            for i, j in zip(x["a_ends"], x["b_ends"]):
                text.append(",".join(map(str, x["a_ids"][lo[0]:i])) + "|" + ",".join(map(str, x["b_ids"][lo[1]:j])))
                lo = (i, j)
            assert hashlib.sha256(";".join(text).encode()).hexdigest() == r["groups_sha256"]
    assert AL.alignment_digest(empty(spark)).collect() == []


def test_alignment_pieces(monkeypatch):
    """The tokens of the pieces are the tokens of the whole text by the libraries, however short they are."""
    rng = random.Random(9)
    texts = [prose(rng, 900).replace(",", rng.choice([",", "  ", " ▁", "\n ", "\x1c", " \x85 "])) for _ in range(6)] + ["", " ", "  ", " x ", "\n \n", "a" * 5000]
    texts += ["".join(rng.choice("ab é漢\n🙂'1,▁\t\xa0\u3000’`~") for _ in range(300)) for _ in range(30)]
    pair = AL.Pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr(AL, "PIECE_CHARS", 9)
    assert pair.cuts and pair.fast and max(len(pair.pieces(t)) for t in texts) > 100
    entries = [x.decode() for x in pair.a_bytes if x[:1] == b" " and x[1:2] not in (b"", b" ") and AL._LATIN.fullmatch(x.decode(errors="replace"))]
    assert len(entries) > 20_000  # every entry encodes alone as itself, by ranks as by the library
    assert [pair.fast(x) for x in entries] == [e.ids for e in pair.a.encode_batch(entries, add_special_tokens=False)]
    for a, b, text in zip(*pair.encode(texts), texts):
        whole = (" " + text).encode()
        ids_a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = pair.b.encode(text)
        same = bool(text) and b"".join(pair.a_bytes[i] for i in ids_a) == whole == b"".join(pair.b_bytes[i] for i in ids_b)
        assert (a, b) == ((ids_a, ids_b) if same else ([], []))


def test_alignment_blocks(spark):
    data = [(i, t, None, None, None, "s", "t", "u") for i, t in enumerate(["one two three", "two three", "three", "one two three four"] * 5)]
    want = sorted(tuple(r) for r in AL.alignment_digest(frame(spark, data, 1)).collect())
    got = sorted(tuple(r) for r in AL.alignment_digest(frame(spark, data, 7)).collect())
    assert got == want and spark.createDataFrame(data, SCHEMA).count() == len(want)
