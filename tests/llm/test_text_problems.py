from collections import defaultdict
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import conversations as C
from loomwork.llm import cross_split as S
from loomwork.llm import formatting_duplicates as D
from loomwork.llm import language as L
from loomwork.llm import leakage as K
from loomwork.llm import packing as P
from loomwork.llm import personal_data as N
from loomwork.llm import truncation as T

EN = ["the phone does not start and I am very angry about this", "please tell me what I should do with the battery", "it was working fine before the last update of the system"]
ES = ["el teléfono no se enciende y estoy muy enfadado con esto", "por favor dime qué debo hacer con la batería", "funcionaba bien antes de la última actualización del sistema"]
DE = ["das Telefon startet nicht und ich bin sehr verärgert darüber", "bitte sagt mir was ich mit dem Akku machen soll", "vor dem letzten Update hat alles gut funktioniert"]


def test_languages(spark):
    rows = []
    for r in range(20):
        for i, texts in enumerate((EN, ES, DE)):
            rows += [(r * 100 + i * 10 + j, t, ("en", "es", "de")[i], f"h{i}") for j, t in enumerate(texts)]
    rows += [(9001, EN[0] + ". " + ES[1], "en", "h0"), (9002, DE[1], "en", None), (9003, ES[0], None, "h1"), (9004, EN[1], " EN-us ", "h0"), (9005, None, "en", "h0"), (9006, "12 !!", "en", "h0")]
    df = spark.createDataFrame(rows, "key bigint, text string, label string, host string").withColumn("lang", F.lit("clash"))
    out = L.identify(df).cache()
    got = {r.key: r for r in out.filter("key > 9000").collect()}
    assert [p.lang for p in got[9001].passages] == ["en", "es"] and got[9002].lang == "de" and got[9003].lang == "es"
    assert got[9004].lang == "en" and got[9005].lang is None and got[9006].lang is None and 0 < got[9003].confidence <= 1
    it = "il telefono non si accende più e sono molto arrabbiato perché nessuno mi risponde da ieri sera"
    alien = spark.createDataFrame(rows + [(9100, it, None, "h0")], "key bigint, text string, label string, host string")
    assert L.identify(alien).filter("key = 9100").first().lang == L.OTHER
    found = {(r.key, r.lang) for r in L.doubtful_languages(out).filter("key > 9000").collect()}
    assert found == {(9001, "en"), (9001, "es"), (9002, "de"), (9003, "es")}
    assert L.doubtful_languages(out).filter("key < 9000").count() == 0


RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, loaded_at timestamp"


def msg(i, parent, who, minute, text="hello"):
    at = None if minute is None else f"Mon Jan 01 10:{minute:02d}:00 +0000 2018"
    return (str(i), who, None if who is None else str(who.isdigit()), at, text, None, parent, datetime(2018, 1, 1))


def test_conversations(spark):
    rows = [
        msg(1, None, "7", 5), msg(2, "1", "B", 9), msg(3, "1", "7", None), msg(4, "2", "7", 7),  # kept
        msg(10, None, "7", 5), msg(11, "10", "7", 6),  # unanswered
        msg(20, "999", "7", 5), msg(21, "20", "B", 6),  # broken
        msg(30, "31", "7", 5), msg(31, "30", "B", 6),  # a circle
        msg(40, None, "7", 5, "@B https://x.example/a"), msg(41, "40", "B", 6),  # empty
        msg(50, None, None, 5), msg(51, "50", "B", 5),  # equal times, unknown sender is a customer
    ]
    df = spark.createDataFrame(rows + rows[:2], RAW)
    got = [(r.root, r.turn, r.id, r.role) for r in C.rebuild_conversations(df).orderBy("root", "turn").collect()]
    assert got == [(1, 1, 1, "customer"), (1, 2, 4, "customer"), (1, 3, 2, "brand"), (1, 4, 3, "customer"), (50, 1, 50, "customer"), (50, 2, 51, "brand")]


GAPS = "id int, child_sender string, parent_sender string, gap int"


def test_clock_offsets(spark):
    import random

    rnd = random.Random(1)
    planted = {"slow": -600, "fast": 3000, "ok": 0, "fine": 0, "z": 0}
    rows = []
    for i in range(3000):
        c, p = rnd.sample(list(planted), 2)
        rows.append((i, c, p, -rnd.randint(5, 60) - planted[c] + planted[p]))
    rows += [(9000 + i, "ok", "fine", rnd.randint(1, 80_000)) for i in range(40)]  # stray times, no clock
    off = {r.sender: r.offset for r in C.clock_offsets(spark.createDataFrame(rows, GAPS)).collect()}
    assert set(off) == {"slow", "fast"} and abs(off["slow"] - 600) < 60 and abs(off["fast"] + 3000) < 60
    # z answers a sender whose clock is moved: its constraints hold before and are counted after
    chain = [(i, "slow", "ok", 600) for i in range(40)] + [(100 + i, "z", "slow", -10) for i in range(20)] + [(200 + i, "x", "ok", -30) for i in range(60)]
    off = {r.sender: r.offset for r in C.clock_offsets(spark.createDataFrame(chain, GAPS)).collect()}
    assert set(off) == {"slow"} and 395 < off["slow"] < 605
    assert C.clock_offsets(spark.createDataFrame(chain[:5], GAPS)).count() == 0 and C.clock_offsets(spark.createDataFrame([], GAPS)).count() == 0


def test_clock_offsets_are_the_least_squares(spark):
    import numpy as np

    # every clock is ten minutes behind the one it answers, so the last is known only through all others
    rows = [(100 * k + i, f"s{k}", f"s{k - 1}" if k else "ok", 600 - 3 * (i % 7)) for k in range(5) for i in range(20)]
    rows += [(900 + i, "z", "s2", -10 * i) for i in range(15)]  # broken only when s2 is moved
    rows += [(1000 + i, "x", "ok", -30) for i in range(60)]
    off = {r.sender: r.offset for r in C.clock_offsets(spark.createDataFrame(rows, GAPS)).collect()}
    at = {f"s{k}": k for k in range(5)}
    assert set(off) == set(at)
    c, p = (np.array([at.get(r[i], 5) for r in rows]) for i in (1, 2))
    gap, o = np.array([float(r[3]) for r in rows]), np.zeros(6)  # the last one stands for the anchors
    squares = lambda o: np.sum(np.maximum(gap + o[p] - o[c], 0) ** 2) + 1e-3 * np.sum(o * o)
    for _ in range(100_000):  # small steps downhill, never past the lowest place
        r = np.maximum(gap + o[p] - o[c], 0)
        o += (np.bincount(c, r, 6) - np.bincount(p, r, 6) - 1e-3 * o) / 100
        o[5] = 0
    got = np.array([off[f"s{k}"] for k in range(5)] + [0.0])
    assert np.abs(got - o).max() < 1 and squares(got) < squares(o) * 1.01 + 1 and got[4] > 1000


def test_corrected_times_decide_the_order(spark):
    rows = []
    for i in range(20):
        a, b = 1000 + 10 * i, 1001 + 10 * i
        rows += [msg(a, None, str(70 + i), 20), msg(b, str(a), "Slow", 11)]  # the brand answers a minute later, its clock is ten minutes slow
    rows += [msg(5000, None, "8", 5), msg(5001, "5000", "Other", 4), msg(6000, None, "8", 5), msg(6001, "6000", "Other", 9)]
    df = spark.createDataFrame(rows, RAW)
    got = C.rebuild_conversations(df).cache()
    assert got.filter("root < 5000 and turn = 1 and role = 'customer'").count() == 20 and got.filter("root < 5000 and time > t").count() == 20
    assert [r.id for r in C.rebuild_conversations(df, tolerance=30).filter("root >= 5000").orderBy("id").collect()] == [6000, 6001]
    assert got.filter("root = 5000").count() == 0  # by the times as sent the answer came first


def test_cross_split_against_all_pairs(spark):
    import random

    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    train = [(i, " ".join(rnd.sample(vocab, rnd.randint(1, 9)))) for i in range(300)] + [(1000 + i, "same text in many rows") for i in range(200)]
    ev = [(5000 + i, " ".join(rnd.sample(train[rnd.randrange(300)][1].split(), 1) + train[i][1].split())) for i in range(60)] + [(6000, "Same TEXT, in many rows"), (6001, None), (6002, "@x https://a.example")]
    a, b = spark.createDataFrame(ev, "id int, text string"), spark.createDataFrame(train + train[:3] + [(7000, "")], "id int, text string")
    got = {(r.eval_id, r.train_id) for r in S.cross_split_overlaps(a, b).collect()}
    ws = lambda t: set() if t is None or t.startswith("@") else set(t.lower().replace(",", "").split())
    want = {(i, j) for i, x in ev for j, y in train if ws(x) and 2 * len(ws(x) & ws(y)) >= 0.8 * (len(ws(x)) + len(ws(y))) - 1e-9}
    assert got == want and len(want) > 250
    import math

    for scheme in ("idf", "unit"):
        lc, rc = S.word_classes(a)[1], S.word_classes(b)[1]
        idf = {(r.l_cls, r.r_cls): r.cosine for r in S.cosine_pairs(lc, rc, 0.6, scheme).collect()}
        ls, rs = lc.collect(), rc.collect()
        df = defaultdict(int)
        for r in [*ls, *rs]:
            for w in r.terms:
                df[w] += 1
        weight = {w: math.log(1 + (len(ls) + len(rs)) / n) if scheme == "idf" else 1.0 for w, n in df.items()}
        norm = lambda t: math.sqrt(sum(weight[w] ** 2 for w in t))  # noqa: B023, E731
        cos = {(x.cls, y.cls): sum(weight[w] ** 2 for w in set(x.terms) & set(y.terms)) / (norm(x.terms) * norm(y.terms)) for x in ls for y in rs}
        exact = {k: v for k, v in cos.items() if v >= 0.6 - 1e-9}
        assert set(idf) == set(exact) and len(exact) > 50 and all(abs(idf[k] - v) < 1e-9 for k, v in exact.items())
    assert S.cross_split_overlaps(a.filter("id < 0"), b).count() == 0


def test_formatting_duplicates_against_grouping(spark):
    base = [f"Text number {i} of the LIST" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t.upper().replace(" ", "  ") + "!!") for i, t in enumerate(base[:150])]
    rows += [(2000 + i, "hot, text") for i in range(400)] + [(3000, "@B Device: a; Ref: 1"), (3001, "@b ref : 1 | DEVICE : A"), (3002, None), (3003, " ?! "), (0, base[0]), (3004, "x" * 100_000), (3005, "X" * 100_000)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(6).withColumn("first", F.lit("clash"))
    want = defaultdict(set)
    for i, t in rows:
        if t and D.canonical(t):
            want[D.canonical(t)].add(i)
    pairs = {(min(v), x) for v in want.values() if len(v) > 1 for x in v}
    for size in ({"step": 4, "bucket_bytes": 3000, "task_bytes": 5000}, {}):
        assert {(r.first, r.id) for r in D.formatting_groups(df, **size).collect()} == pairs
    assert D.formatting_groups(df.filter("id < 0")).count() == 0
    assert sorted(r.copies for r in D.collapse(df).collect()) == sorted(len(v) for v in want.values())
    assert {(r.first, r.id, r.copies) for r in D.formatting_groups(df).collect()} == {(min(v), x, len(v)) for v in want.values() if len(v) > 1 for x in v}
    assert {(r.first, r.id) for r in D.formatting_pairs(df).collect()} == {p for p in pairs if p[0] != p[1]}


def test_copies_are_distinct_ids(spark):
    rows = [(1, "alpha"), (2, "Alpha!"), (1, "beta"), (3, "BETA"), (5, "once"), (5, "once")]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(6)
    assert sorted((r.first, r.copies) for r in D.collapse(df).collect()) == [(1, 2), (1, 2), (5, 1)]
    assert sorted((r.first, r.id, r.copies) for r in D.formatting_groups(df).collect()) == [(1, 1, 2), (1, 1, 2), (1, 2, 2), (1, 3, 2)]
    long = "a very long name of a field that goes on and on: x; ref: 1"
    assert D.canonical(long) == D.canonical("REF: 1; a very long name of a field that goes on and on: X")


@given(st.lists(st.binary(max_size=12), max_size=300))
@settings(max_examples=40, deadline=None)
def test_trie_counts(keys):
    trie, want = D.BurstTrie(burst=3), defaultdict(int)
    for k in keys:
        trie.add(k, 1, 0)
        want[k] += 1
    assert {k: n for k, n, _ in trie.terminals()} == dict(want)


@given(st.text("0123456789", max_size=20), st.binary(min_size=1, max_size=16))
@settings(max_examples=80, deadline=None)
def test_feistel_round_trip(value, key):
    there = N.feistel(value, key)
    assert len(there) == len(value) and N.feistel(there, key, back=True) == value


def test_feistel_is_a_permutation():
    assert len({N.feistel(f"{i:03d}", b"k") for i in range(1000)}) == 1000


def kinds(text):
    return sorted({h.kind for h in N.find(text)})


def test_personal_details(spark):
    assert kinds("write to kofi+help @ mail.example please") == ["email"] and kinds("amira at inbox dot example dot net") == ["email"]
    assert kinds("call me on (601) 555-0145") == ["phone"] and kinds("my number is 9345550166") == ["phone"] and kinds("text +44 7700 900821 any time") == ["phone"]
    assert kinds("my SSN is 903-87-4247") == ["id_number"] and kinds("Mi DNI es 93367279O") == ["id_number"] and kinds("NI number QQ 06 60 25 C since 8") == ["id_number"]
    assert kinds("I live at 12b Oak St., Town") == ["street_address"] and kinds("vivo en Calle Mayor 12, 3º B") == ["street_address"] and kinds("ich wohne im Eichenweg 95") == ["street_address"]
    assert kinds("my name is Orla Pellow") == ["name"] and kinds("signed, Pellow, Orla") == ["name"] and kinds("@100 Hi Nadia, We want") == ["name"] and kinds("booked for A. Pellow") == ["name"]
    for clean in ("order 343-8901428", "tracking no 1Z391628757", "invoice 795-81-29", "part no. 554-82584", "my name day reminder is gone", "please ask for Siri to be fixed",
                  "signed, a loyal user", "I live for this phone", "street view is broken", "since 10.13.2 at 7:41pm ^AB", "@Brand hello", "paid 944.68 at your 5th floor shop", ""):
        assert kinds(clean) == [], clean
    text = "My number is 020 7946 0536, again 020 7946 0536. Thanks"
    out, types = N.redact(text, KEY)
    assert types == ["phone"] and "0536" not in out.replace("7946 0536", "") and out.endswith(". Thanks") and out.count(out.split("<phone:")[1].split(">")[0]) == 2
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "key int, text string")
    got = {r.key: (r.redacted, r.types) for r in N.redact_rows(df, KEY).collect()}
    assert got[2] == (None, []) and got[3] == (" ", []) and got[1][1] == ["phone"]


KEY = b"0123456789abcdef"


def test_numbers_are_validated_and_formats_kept():
    assert kinds("my SSN is 000-00-0000") == [] and kinds("it is 666-12-3456") == [] and kinds("it is 123-45-6789") == ["id_number"] and kinds("call me on 000 000 0000") == []
    new = N.pseudonym("+44 7700 900821", "phone", KEY)
    assert new.startswith("+44 ") and new != "+44 7700 900821" and len(new) == 15 and N.pseudonym("+447700900821", "phone", KEY)[:3] == "+44"
    for value in ("31.12.1985", "1985-03-12", "12/31/1985", "1/2/1999"):
        new = N.date_pseudonym(value, KEY)
        assert N.read_date(new) and new != value and len(new) == len(value) or value == "1/2/1999" and N.read_date(new)
    assert N.read_date("31.02.1985") is None and N.read_date("13/13/1985") is None
    out, types = N.redact("I was born on 31.12.1985, really 31.12.1985", KEY)
    assert types == ["birth_date"] and out.endswith("really 31.12.1985")
    assert len({N.date_pseudonym(f"1985-03-{d:02d}", KEY) for d in range(1, 32)}) == 31
    assert len(N.token("Ana", KEY)) == 32 and N.token("Ana", KEY) == N.token(" ana ", KEY) != N.token("Ana", b"another key here")
    try:
        N.redact_rows(None, b"short")
        raise AssertionError("a short key must be refused")
    except ValueError:
        pass


def test_names_are_learned_from_contexts(spark):
    texts = [f"my name is Maria Lopez, number {i}" for i in range(6)] + [f"@1 Hi Nadia, we can help {i}" for i in range(6)] + [f"my name is Apple {i}" for i in range(6)]
    texts += [f"the Apple shop number {i}" for i in range(30)] + ["Maria Lopez told me", "I met Nadia there", "the Apple shop", "see @Nadia or https://a.example/Nadia", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    names = N.learn_names(df)
    assert {r.word for r in names.collect()} == {"maria", "lopez", "nadia"}
    got = {r.key: r.redacted for r in N.redact_rows(df, KEY, names).collect()}
    n = len(texts)
    assert got[n - 6] == f"<name:{N.token('Maria Lopez', KEY)}> told me" and got[n - 5].startswith("I met <name:") and got[n - 4] == texts[n - 4] and got[n - 3] == texts[n - 3]
    assert got[n - 2] is None and got[n - 1] == "" and len(got) == n


def test_packing_keeps_every_token(spark):
    sizes = [(i, (i * 37) % 300) for i in range(500)] + [(900, 1000), (901, 100), (902, 200)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([(1, 100), (2, 256), (3, 0), (2, 256)], "budget_id int, capacity_tokens int")
    for rule in ("norm", "dot"):
        out = P.pack(df, budgets, max_docs=9, attention=0.8, shard_items=200, rule=rule).cache()
        caps = {1: 100, 2: 256}
        for b, cap in caps.items():
            rows = out.filter(F.col("budget_id") == b)
            assert rows.agg(F.sum("n_tokens")).first()[0] == sum(s for _, s in sizes)
            per = rows.groupBy("bin_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a")).collect()
            assert all(r.t <= cap and r.c <= 9 and (r.a <= 0.8 * cap * cap + 1e-6 or r.c == 1) for r in per)
            whole = rows.join(df.filter(F.col("n_tokens") <= cap).select("doc_id"), "doc_id").groupBy("doc_id").count().filter("count > 1").count()
            assert whole == 0
    bins = {a: P.pack(df, budgets, max_docs=9, attention=a).filter("budget_id = 1").select("bin_id").distinct().count() for a in (1.0, 0.5)}
    assert bins[0.5] > bins[1.0]  # the attention cost binds
    full = P.fill_report(P.pack(df, budgets), budgets).collect()
    assert all(r.n_bins >= r.least_bins and r.n_bins <= 1.05 * r.least_bins + 2 for r in full)
    assert P.pack(df.filter("doc_id < 0"), budgets).count() == 0 and P.pack(df, budgets.filter("budget_id = 3")).count() == 0


def test_leaks_against_windows(spark):
    import random

    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(40)]
    items = [(f"b{i}", " ".join(rnd.choice(vocab) for _ in range(20))) for i in range(12)] + [("short", "one two"), ("none", None)]
    docs = []
    for i in range(200):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        src = items[rnd.randrange(12)][1].split()
        n = rnd.randint(8, 16)
        at = rnd.randint(0, 20 - n) if n < 20 else 0
        docs.append((i, " ".join(w + src[at : at + n] + w[:5]).upper()))
    docs += [(999, None), (1000, "")]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item string, text string")
    got = {(r.doc_id, r.item) for r in K.leaked_passages(a, b).collect()}
    grams = lambda t: set() if t is None else {tuple(t.lower().split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    want = {(i, k) for i, t in docs for k, u in items if grams(t) & grams(u)}
    assert got == want and len(want) > 50
    near = {(r.doc_id, r.item) for r in K.leaked_passages(a, b, slack=2).collect()}
    assert want <= near


def test_truncation(spark):
    whole = ["All is well here. Thanks for that.", "It works now!\nRegards\nthe desk", "See you. Ref 12345", "Fine. https://a.example/x", "Good. 😊", "He said “yes.”", "<p>Done.</p>", "Ok.\n--", " "]
    cut = ["All is well here. Thanks for th", "It works now! The pho…", "It works now! The pho...", "It works. The screen tu&quo", 'Fine here. See <a href="htt', "Good so far. And th�", "Nice one. Then C:\\u00"]
    docs = [(i, "s1", t) for i, t in enumerate(whole)] + [(100 + i, "s1", t) for i, t in enumerate(cut)] + [(200 + i, "s1", f"Sentence number {i} is complete.") for i in range(60)]
    docs += [(300 + i, "s2", f"no full stops in this source {'x' * i}") for i in range(60)] + [(400, None, None), (401, None, "Whole.")]
    out = T.truncated(spark.createDataFrame(docs, "doc_id bigint, source string, text string"))
    assert {r.doc_id for r in out.filter("cut").collect()} == set(range(100, 107))
    by = {r.source: r.n_cut for r in T.truncation_by_source(out).collect()}
    assert by["s1"] == 7 and by["s2"] == 0 and by[""] == 0


def test_whole_text_is_read():
    assert T.ending("Good. See <a href=\"https://a.example/" + "x" * 5000)["broken"] == "markup"
    for text in ("made by AT&T", "the R&D", "Q&A", "a < b and"):
        assert T.ending(text)["broken"] is None, text
    for text in ("see &amp", "see &#82", "tu&quo", "then\\u00e"):
        assert T.ending(text)["broken"], text
    long = "word " * 3000
    a, b = T.ending("One. " + long + "end"), T.ending("Two. " + long + "end")
    assert a["tail"] == b["tail"] != T.ending("One. " + "other " + long + "end")["tail"]
    assert T.ending("x" * 200_000 + "!?(")["last"] is None


def test_truncation_of_most_texts_of_a_source(spark):
    import random

    words = "please restart the router before calling again because technicians require another appointment tomorrow morning".split()
    sentence = lambda i: " ".join(random.Random(i).sample(words, len(words)))
    docs = [(i, "s1", f"Ticket {i} came in. {sentence(i).capitalize()}.") for i in range(40)]
    docs += [(1000 + i, "s1", f"Ticket {i} came in. He said \"{sentence(i)[: 30 + i % 45].rstrip()}") for i in range(160)]
    docs += [(2000 + i, "s2", f"no full stops in number {i} {words[i % 5]}") for i in range(60)] + [(3000, "s2", "no full stops and then the rou...")]
    docs += [(4000 + i, "s3", f"Case {i} is done. {sentence(i).capitalize()[:50]} [...]") for i in range(30)]
    out = T.truncated(spark.createDataFrame(docs, "doc_id bigint, source string, text string"))
    assert {r.doc_id for r in out.filter("cut").collect()} == {*range(1000, 1160), 3000, *range(4000, 4030)}


def test_copies_of_cut_texts_are_no_closing_lines(spark):
    import random

    words = "please restart the router before calling again because technicians require another appointment tomorrow morning".split()
    sentence = lambda i: " ".join(random.Random(i).sample(words, len(words)))
    docs = [(i, "s1", f"Ticket {i} came in. {sentence(i).capitalize()}.") for i in range(60)]
    docs += [(1000 + i, "s1", "Hello there. The technici") for i in range(30)] + [(1100 + i, "s1", f"{sentence(i).capitalize()}.\n{m}") for i, m in enumerate(["[...]", "[truncated]", "..."] * 8)]
    docs += [(2000 + i, "s1", f"{sentence(i).capitalize()}.\nYour router desk") for i in range(12)]  # a closing line
    docs += [(3000 + i, "s1", f"{sentence(i).capitalize()}.\nThis came from technici") for i in range(12)]  # the same cut of a footer
    out = T.truncated(spark.createDataFrame(docs, "doc_id bigint, source string, text string"))
    assert {r.doc_id for r in out.filter("cut").collect()} == {*range(1000, 1030), *range(1100, 1124), *range(3000, 3012)}


def test_proximity_against_all_offsets(spark):
    import random

    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(f"b{i}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(12, 24)))) for i in range(12)]
    items += [("rare", " ".join([*vocab[:10], "unique", *vocab[20:29]])), ("short", "one two"), ("none", None)]
    docs = [(5000, " ".join([*vocab[:10], "edited", *vocab[20:29]])), (5001, None), (5002, "")]
    for i in range(300):
        w = items[rnd.randrange(13)][1].split()
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
        docs.append((i, " ".join([rnd.choice(vocab) for _ in range(rnd.randint(0, 9))] + w)))
    want = {}
    for d, text in docs:
        for item, t in items:
            w, q = (text or "").split(), (t or "").split()
            for off in range(-len(q) - 2, len(w) + 3):
                found = [term in w[max(0, off + i - 2) : max(0, off + i + 3)] for i, term in enumerate(q)]
                if sum(found) >= 12:
                    run = max(len(r) for r in "".join(".x"[f] for f in found).split("."))
                    a, b = want.get((d, item), (0, 0))
                    want[d, item] = (max(a, sum(found)), max(b, run))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item string, text string")
    got = {(r.doc_id, r.item): (r.n_matched, r.longest_run) for r in K.leaked_passages(a, b, slack=2).collect()}
    assert got == want and (5000, "rare") in got and len(want) > 100


def test_gates_lose_no_personal_details():
    found = {"12 Oak Drive.": "street_address", "5 Quai Voltaire": "street_address", "Marktplein 7": "street_address", "9 Elm Dr": "street_address", "3 Hay Mews": "street_address", "12 Oak\nSt": "street_address",
             "4 allée Verte": "street_address", "Deichufer 3": "street_address", "em nome de Rui Alves": "name", "TIN 12345": "id_number", "sofinummer 123456": "id_number", "a@b.example": "email", "RG 12345": "id_number"}
    for text, kind in found.items():
        assert kinds(text) == [kind], text
    labels = [x.replace(r"\s", " ") for p in (N._STREET_WORDS, N._STREET_WEAK) for x in p.split("|")]
    texts = [*found, *EN, *ES, *DE] + [f"I live at 7 Long {w}, {q}" for w in labels for q in ("ok", "")] + [f"7 Long {w}" for w in labels]
    for pattern in (N._NAME_LABEL, N._ID_LABEL, N._PLACE_LABEL):
        for x in pattern.split("|"):
            label = x.replace(r"\s", " ").replace("?", "").replace("(:", "").replace(")", "").replace("(", "")
            texts += [f"{v} {w}" for v in (label, label.upper()) for w in ("Rui Alves", "12345", "7 Long Close")]
    for text in texts:
        assert N._find(text) == N._find(text, gated=False), text
