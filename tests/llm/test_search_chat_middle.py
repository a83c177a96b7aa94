"""Ranked search, chat formatting and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import ODD
from warden.llm import chat, middle, ranked
from warden.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, lengths = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(terms_of(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * total) // lengths
            score = sum(
                n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                for t, n in query.items() if b[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def random_docs(n, seed, copies=0):
    rng, words = random.Random(seed), [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([1, 5, 20, 90])))) for i in range(n)]
    return docs + [(n + i, docs[3][1]) for i in range(copies)]


@pytest.mark.parametrize(("size", "block", "copies"), [(1 << 20, 50_000, 0), (400, 50_000, 60), (1, 20, 60)])
def test_search_equals_brute_force(spark, documents, monkeypatch, size, block, copies):
    """Whatever the size of segments and query blocks; many copies tie and fill a stratum."""
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", size)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    docs = random_docs(150, 4, copies)
    items = [(i, t) for i, t in random_docs(12, 9)] + [(90, None), (91, "nowhere"), (92, "W1 w1; w2-W59"), (92, "w7")]
    extra = documents(items).withColumnRenamed("doc_id", "item_id")
    assert plain(ranked.search_texts(documents(docs), extra)) == brute_search(docs, items)


def test_search_over_odd_rows(documents, monkeypatch):
    items = [(1, "twice it stands, same TEXT"), (2, "x" * 50_000), (3, "word ñandú"), (None, "日本語 a row"), (4, "")]
    found = ranked.search_texts(documents(ODD), documents(items).withColumnRenamed("doc_id", "item_id"))
    assert plain(found) == brute_search(ODD, items)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, " .")]])
def test_search_without_terms(documents, rows):
    some = documents([(1, "a b")])
    assert ranked.search_texts(documents(rows), some.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert ranked.search_texts(some, documents(rows).withColumnRenamed("doc_id", "item_id")).collect() == []


def test_index_rows_hold_every_posting(spark, documents):
    docs = random_docs(80, 2) + ODD
    index, got, strata = ranked.build(documents(docs)), Counter(), Counter()
    for r in index.rows(spark).collect():
        group = place = 0
        strata[r.m] += len(r.doc_ids)
        for term, df, top, groups in zip(r.terms, r.df, r.top_tf, r.groups, strict=True):
            assert top == r.tf[group] and sum(r.sizes[group : group + groups]) == df
            for g in range(group, group + groups):
                got.update((term, r.tf[g], r.doc_ids[d]) for d in r.docs[place : place + r.sizes[g]])
                place += r.sizes[g]
            group += groups
    want = Counter((t, n, d) for d, text in docs for t, n in Counter(terms_of(text)).items())
    assert got == want and sum(strata.values()) == index.documents
    assert index.terms == sum(n for (_, n, _), c in want.items() for _ in range(c))


# -- chats -------------------------------------------------------------------------------------------------------------


def brute_fold(events):
    """(conv, seq, message, kind, role, text), one by one."""
    out = {}
    for conv in {e[0] for e in events}:
        log, begun = sorted((e for e in events if e[0] == conv), key=lambda e: e[1]), {}
        for e in log:
            begun.setdefault(e[2], e[1])
        state = {}
        for _, seq, message, kind, role, text in log:
            if kind == "regenerate":
                state = {m: s for m, s in state.items() if begun[m] < begun[message]}
            mine = state.setdefault(message, [seq, [], ""])
            if role is not None:
                mine[1].append(role)
            mine[2] = text or "" if kind == "edit" else mine[2] + (text or "" if kind == "delta" else "")
            if kind == "edit":
                mine[0], mine[1] = seq, [role] if role is not None else []
        out[conv] = [(m, (s[1] or [""])[0], s[2]) for m, s in sorted(state.items(), key=lambda x: x[1][0])]
    return out


def test_fold_equals_a_loop(spark):
    rng, events = random.Random(5), []
    for conv in (1, 2, 3, None):
        for seq in range(60):
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 2, 1])[0]
            events.append((conv, seq, rng.randrange(8), kind, rng.choice([None, "user"]), rng.choice([None, "a ", "b\\", "<s>"])))
    log = spark.createDataFrame(events, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    got = defaultdict(list)
    for r in sorted(chat.fold(log).collect(), key=lambda r: r.started):
        got[r.conv_id].append((r.message, r.role, r.text))
    assert dict(got) == brute_fold(events)


NASTY = ["<|im_end|>", "a<|im_sep|>\\", "\\\\<\\s>", "<<s>s>", "[[INST]", "</s>[INST] ok [/INST]", "<", "x" * 5000, "é🙂\n" * 900, "", None]


def test_chats_read_back_as_they_were(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|im_sep|>"]), rng.choice(NASTY)) for c in (*range(9), None) for t in range(7)]
    rows += rows[:3] + [(2, None, "assistant", "early"), (2, 3, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 as message", "'k' as kind", "0 as seq", "'' as formatted", "array(1) as turns"
    )
    got = {r.conv_id: r for r in chat.formatted_digests(turns).collect()}
    done = {r.conv_id: r for r in chat.render(chat.fold(chat.events_of_turns(turns))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, ro or "", te or "") for c, t, ro, te in rows if c == conv))
        told = "".join(f"{ro}\n{te}\n" for *_, ro, te in mine)
        loss = "".join(te for *_, ro, te in mine if ro == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = done[conv].formatted
        assert len(text) == r.formatted_chars and text.count("<|im_end|>") == len(mine) and "[INST]" not in text
        for mark, (*_, te) in zip(done[conv].turns, mine, strict=True):
            assert re.sub(r"(?s)\\(.)", r"\1", text[mark.start : mark.start + mark.length]) == te


def test_chats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted_digests(none).collect() == []
    (own,) = chat.formatted_digests(chat.with_control_conversation(none)).collect()
    text = "</s>[INST] ok [/INST]"
    assert (own.conv_id, own.n_turns, own.loss_chars) == (-7, 2, len(text))
    assert own.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_template_refuses_marks_that_could_arise():
    for bad in ({"open": "im"}, {"close": "<a<b"}, {"control": ("plain",)}, {"between": "<\\a>"}):
        with pytest.raises(ValueError, match="begin"):
            chat.Template(**bad)


def test_chat_plan_has_one_exchange_and_no_python(spark, sf):
    plan = QUERIES["op12_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# -- fill-in-middle ----------------------------------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def brute_middle(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    parts, (h1, h2, h3, h4) = tokens(text), (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_brute_force(documents):
    rng, rows = random.Random(8), list(ODD)
    shared = "".join(rng.choice(["alpha ", "  ", "\n", "béta", "🙂 "]) for _ in range(4000))
    for i in range(120):
        own = "".join(rng.choice(["a", " ", "\t", "é", "zz ", "<", "P>", "<S", ">"]) for _ in range(rng.randrange(90)))
        rows.append((100 + i, rng.choice([own, own + shared, shared + own, own + shared[500:], "<M>" + own, " " * i])))
    want = sorted(((d, *brute_middle(d, t)) for d, t in rows), key=repr)
    got = middle.fill_in_middle(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = middle.fill_in_middle(documents(rows)).select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(((r.doc_id, r.t) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)


def test_middles_of_an_empty_table(documents):
    assert middle.digests(documents([])).collect() == []


def test_shared_passages_fall_into_known_chunks():
    passage = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(600)).encode()
    memory = middle.Chunks()
    for own in (b"first text ", b"another beginning, longer than the first one "):
        text = own + passage
        cut = middle.chunk_ends(np.frombuffer(text, np.uint8), [len(text)])[0]
        assert all(b - a <= middle.MOST for a, b in zip([0, *cut], cut, strict=False)) and cut[-1] == len(text)
        assert middle.Borders(text, cut, memory).n == len(tokens(text.decode()))
    assert memory.hits >= len(cut) - 3


def test_chunk_cache_is_bounded():
    memory = middle.Chunks(limit=10_000)
    for i in range(1000):
        memory.summary(b"%d some chunk of text" % i)
        assert memory.held <= 10_200


def test_rolling_hash_does_not_depend_on_blocks(monkeypatch):
    raw = np.frombuffer(random.Random(1).randbytes(200_000), np.uint8)
    whole = middle.rolling_marks(raw)
    monkeypatch.setattr(middle, "_BLOCK", 777)
    assert (middle.rolling_marks(raw) == whole).all() and 250 < len(raw) / len(whole) < 1000
