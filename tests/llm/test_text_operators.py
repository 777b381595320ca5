"""Token counts, quality rules, decontamination, HTML, chat: brute force and defined cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import chat_format, decontamination, html_extraction, html_tree, quality_rules, token_counts
from gradeloom.llm.common import Blocks, keyed, mapped, packed, unpacked
from gradeloom.session import scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


def random_text(rng, words=60, vocabulary=12):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(words)))


# --- shared helpers ---------------------------------------------------------------------------


def test_blocks_add_up_over_tasks(spark):
    import numpy as np

    def emit(batches):
        n = sum(b.num_rows for b in batches)
        big = np.zeros(Blocks.WIDTH + 10, np.int64)
        big[[0, Blocks.WIDTH + 9]] = n
        yield from Blocks.emit([big, np.array([-n, 0])])

    one, two = Blocks.gathered(mapped(spark.range(0, 1000, 1, 7), emit, Blocks.SCHEMA), [Blocks.WIDTH + 10, 2])
    assert one[0] == one[-1] == 1000 and one.sum() == 2000 and two.tolist() == [-1000, 0]


def test_blocks_hold_any_numbers_and_only_the_bytes_in_use():
    import zlib

    import numpy as np

    for most, used in ((1, 1), (255, 1), (256, 2), (2**24, 4), (2**62, 8), (-1, 8)):
        part = np.zeros(Blocks.WIDTH, np.int64)
        part[[3, -1]] = 1, most
        data = Blocks.batch(0, 0, part).column(2)[0].as_py()
        assert (Blocks.numbers(data) == part).all() and len(zlib.decompress(data[1:])) == used * Blocks.WIDTH


def test_keys_tell_null_from_empty_and_agree_on_equal_rows(spark):
    rows = keyed(docs(spark, ["a", None, "", "a"]).withColumn("doc_id", F.lit(1)), ["doc_id", "text"]).collect()
    keys = [(r["_k1"], r["_k2"]) for r in rows]
    assert keys[0] == keys[3] and len(set(keys)) == 3


def test_packed_rows_come_back_whatever_their_columns_are_called(spark):
    df = docs(spark, ["x"], _k1=5, row=6, n=7)
    assert unpacked(packed(df, ["doc_id", "text"])).collect() == df.collect()


# --- token counts -----------------------------------------------------------------------------

ODD = [
    None, "", "   ", "plain words", "two\t\tlines\n\nhere ", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>",
    "é éx İstanbul ΣΑΣ ς", "don't I'LL 123", "\u0085x\u001cy  z", "中文 字 👩‍👩‍👧", "word " * 5000, "plain words",
]


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_counts_are_the_librarys(spark, model):
    from tokenizers import Tokenizer

    counted = token_counts.token_counts(docs(spark, ODD, content="x", n_tokens=1), model, scratch_path(spark, "cache"))
    encoded = Tokenizer.from_file(model).encode_batch([t or "" for t in ODD], add_special_tokens=False)
    assert sorted(map(tuple, counted.collect())) == [
        (i, len((t or "").encode()), len(e)) for i, (t, e) in enumerate(zip(ODD, encoded, strict=True))
    ]


def test_only_missing_texts_are_added_to_the_cache(spark, model):
    cache = scratch_path(spark, "cache")
    first = token_counts.token_counts(docs(spark, ["a b", "a  b", "c"]), model, cache)
    assert first.count() == 3 and spark.read.parquet(cache).count() == 2
    second = token_counts.token_counts(docs(spark, ["c", "a b", "d e f"]), model, cache)
    assert [r["n_tokens"] for r in second.orderBy("doc_id").collect()] == [1, 2, 3]
    assert spark.read.parquet(cache).count() == 3
    # What the cache says counts: nothing is encoded again.
    digest = token_counts.tokenizer_digest(model)
    other = scratch_path(spark, "cache")
    stored = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    stored.withColumn("tokenizer", F.lit(digest)).write.parquet(other)
    again = token_counts.token_counts(docs(spark, ["c", "a b"]), model, other)
    assert {r["n_tokens"] for r in again.collect()} == {77}


def test_another_tokenizer_has_counts_of_its_own(spark, model):
    cache = scratch_path(spark, "cache")
    key = F.unhex(F.sha2(F.lit("a b"), 256))
    spark.range(1).select(key.alias("content"), F.lit(b"other").alias("tokenizer"), F.lit(9).cast("long").alias("n_tokens")).write.parquet(cache)
    assert token_counts.token_counts(docs(spark, ["a b"]), model, cache).first()["n_tokens"] == 2


def test_token_counts_of_nothing_and_of_repeated_rows(spark, model):
    assert token_counts.token_counts(docs(spark, []), model, scratch_path(spark, "cache")).collect() == []
    twice = docs(spark, ["a b"]).unionAll(docs(spark, ["a b"]))
    assert [tuple(r) for r in token_counts.token_counts(twice, model, scratch_path(spark, "cache")).collect()] == [(0, 3, 2)] * 2


# --- quality rules ----------------------------------------------------------------------------


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rules_count_as_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a a a a", "é#|é x\n\nq\nq", "x\x1cy \x85z"]
    texts += ["\n".join(random_text(rng, 30, 5) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    found = quality_rules.document_rules(docs(spark, texts, host="h", failed=True), quality_rules.Rules()).orderBy("doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r[n] for n in names) for r in found.collect()] == [brute_rules(t) for t in texts]


def test_hosts_lose_all_documents_only_beyond_the_drawn_rate(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(20)] + [(100 + i, "bad", "bad") for i in range(40)]
    rows += [(200, good, "bad"), (300, "bad", None), (301, good, None), (400, "bad", "one"), (401, None, "good")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] for i in range(20)) and not any(kept[100 + i] for i in range(40))
    assert not kept[200] and not kept[300] and kept[301] and not kept[401]


def brute_verdicts(hosts, excess=0.2, sure=3.0, most_rho=0.5):
    """{host: (documents, failures)} to (drawn rate, rejected), by the formulas of beta-binomial moments."""
    n, x = sum(d for d, _ in hosts.values()), sum(f for _, f in hosts.values())
    p, free = x / n, len(hosts) - 1
    room = n - sum(d * d for d, _ in hosts.values()) / n - free
    rho = 0.0
    if 0 < p < 1 and room > 0:
        rho = (sum(d * (f / d - p) ** 2 for d, f in hosts.values()) / (p * (1 - p)) - free) / room
        rho = min(max(rho, 0.0), most_rho)
    weights = {h: d / (1 + rho * (d - 1)) for h, (d, _) in hosts.items()}
    mean = sum(w * hosts[h][1] / hosts[h][0] for h, w in weights.items()) / sum(weights.values())
    found = {}
    for h, (d, f) in hosts.items():
        rate, error = mean, 0.0
        if rho > 0:
            worth = 1 / rho - 1
            a, b = mean * worth + f, (1 - mean) * worth + d - f
            rate, error = a / (a + b), (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
        found[h] = (rate, rate - sure * error > mean + excess)
    return found


@pytest.mark.parametrize(
    ("hosts", "rejected"),
    [
        # One bad host among like ones goes; chance alone rejects nobody.
        ({f"h{i}": (40, 5 + i % 3) for i in range(12)} | {"bad": (60, 50)}, {"bad"}),
        ({f"h{i}": (20, 2 + i % 3) for i in range(20)}, set()),
        # A small host that fails once stays, beside hosts without failures.
        ({f"h{i}": (1, int(i == 0)) for i in range(20)} | {"big": (50, 0)}, set()),
        # A bad host of a third of all documents is not the mean.
        ({f"h{i}": (30, 3 + i % 2) for i in range(40)} | {"hot": (600, 420), None: (5, 1)}, {"hot"}),
        ({"only": (7, 6)}, set()),
        ({"none": (3, 0), "all": (2, 0)}, set()),
    ],
)
def test_host_verdicts_as_brute_force(spark, hosts, rejected):
    rows = [(h, i < f) for h, (d, f) in hosts.items() for i in range(d)]
    measured = spark.createDataFrame(rows, "host string, failed boolean")
    found = {r["host"]: r for r in quality_rules.host_verdicts(measured, quality_rules.Rules()).collect()}
    expected = brute_verdicts(hosts)
    assert {h: (r["host_docs"], r["host_failed"]) for h, r in found.items()} == hosts
    for host, (rate, out) in expected.items():
        assert found[host]["host_rate"] == pytest.approx(rate, abs=1e-9) and found[host]["host_rejected"] == out
    assert {h for h, r in found.items() if r["host_rejected"]} == rejected


def test_the_host_verdict_changes_rows_as_in_sql(spark, tmp_path):
    import duckdb

    good = " ".join(f"w{i}" for i in range(60))
    marked = good + " ####" * 60  # Fails a rule of the host's only, so that its own words keep it.
    rows = [(i, marked if i % 8 == 0 else good, f"h{i % 6}") for i in range(120)]
    rows += [(1000 + i, good if i % 10 == 0 else marked, "bad") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("kept", F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = quality_rules.op5_quality_rules(spark, str(tmp_path)).toPandas()
    out = set(found[~found["kept"] & ~found["base_failed"]]["doc_id"])
    assert out == set(range(1000, 1050))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(quality_rules.OP5_SQL).df()[list(found.columns)]
    key = lambda f: sorted(map(tuple, f.itertuples(index=False)))
    assert key(found) == key(expected)


def test_hosts_that_all_agree_have_their_rate(spark):
    df = docs(spark, ["x", "y", "z"])
    verdicts = quality_rules.host_verdicts(quality_rules.document_rules(df, quality_rules.Rules()), quality_rules.Rules())
    assert [r["host_rate"] for r in verdicts.collect()] == [1.0, 1.0, 1.0]
    assert quality_rules.quality_rules(docs(spark, [])).collect() == []


# --- decontamination --------------------------------------------------------------------------


def brute_hits(text, items, size):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            window = w[i : i + size]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_windows_are_found_as_by_brute_force(spark):
    rng = random.Random(2)
    items = [(i, random_text(rng, 12, 3)) for i in range(12)] + [(12, "W1, w2! W0"), (3, "w9 w9"), (None, "w8 w8"), (20, None), (21, "...")]
    texts = [None, "", "w9,W9 w9", "é w1", "w8 w8 w8"] + [random_text(rng, 40, 4) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("word", F.lit(1))
    found = decontamination.contaminated(docs(spark, texts, word="x", window=1), bench, size=4).orderBy("id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in found] == [brute_hits(t, items, 4) for t in texts]


def test_decontamination_of_nothing_by_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    found = decontamination.contaminated(docs(spark, ["a b", None]), bench).collect()
    assert [(r["n_hit"], r["items"]) for r in found] == [(0, []), (0, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontamination.contaminated(docs(spark, []), some).collect() == []
    twice = docs(spark, ["x a b"]).unionAll(docs(spark, ["x a b"]))
    assert [(r["n_hit"], r["items"]) for r in decontamination.contaminated(twice, some).collect()] == [(2, ["1"])] * 2
    assert decontamination.decontaminated(twice.unionAll(docs(spark, ["clean"])), some).collect() == docs(spark, ["clean"]).collect()


# --- HTML -------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>"
    "<header>no</header><nav><ul><li><a href=x>no</a><li><a>no</a></ul></nav><div class='cookie-notice'>no</div>{}"
    "<footer>no</footer>"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just < text &amp; more &#233;&nbsp;x", "just < text & more é x"),
        (PAGE.format("<article><h1>T  <i>i</i>tle</h1><p><b>one.<br><p>two\n three</p><aside>no</aside></article>"), "T i tle one. two three"),
        (PAGE.format("<main><p>in<p>main<form>no<input></form><div id='comments'><p>no</p></div></main>"), "in main"),
        (PAGE.format("<div class=ad-box>no</div><div><p>the body of the page is here</p><p>and goes on</p></div>"), "the body of the page is here and goes on"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>cut off<p cla", "cut off"),
        ("<article><p title=\"a>b\">x</p><!-- <p>no</p> --><p hidden>no</p><textarea>no</textarea>y</article>", "x y"),
        ("<article><header><h1>kept</h1></header><button>no</button>z</article>", "kept z"),
    ],
)
def test_main_text_of_a_page_alone(html, text):
    text = text.replace("T i tle", "T itle")
    assert html_extraction.main_text(html, set()) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE.format("<div class='layout has-sidebar'><article><p>in</p><div class=ad>no</div></article><div class=sidebar>no</div></div>"), "in"),
        (PAGE.format("<div id=page class='no-sidebar'><div class=widget><main>in</main></div><div class=comments><article>no</article></div></div>"), "in"),
        (PAGE.format("<div class='social-study'><p>most of the text of this page</p></div><div>x</div>"), "most of the text of this page"),
        (PAGE.format("<div class=content><p>most of the text of this page</p></div><div class=related><article>no</article><article>no</article></div>"), "most of the text of this page"),
        (PAGE.format("<div>" * 80 + "<article>in</article><p>the rest is around it</p>"), "in"),
    ],
)
def test_words_leave_out_no_element_that_holds_the_article(html, text):
    assert html_extraction.main_text(html, set()) == text


def test_wrappers_fold_repeats_and_make_differences_optional():
    pages = ["<div><h1>a</h1><p>b</div>", "<div><h1>a</h1><p>b<p>c</div><ul><li>1<li>2</ul>"]
    a, b = (html_tree.Page(p).skeleton() for p in pages)
    assert html_tree.expression(html_tree.merged(a, b)) == "<><div><h1>#</> <p>#</>+</> <ul><li>#</>+</>?</>"
    pairs = html_tree.Page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>").skeleton()
    assert html_tree.expression(pairs) == "<><dl>(<dt>#</> <dd>#</>)+</></>"


def test_a_wide_node_is_a_mixture_of_its_kinds():
    rng = random.Random(3)
    kinds = [rng.choice(["p", "pre", "table", "ul"]) for _ in range(400)]
    page = html_tree.Page("".join(f"<{k}>x</{k}>" for k in kinds))
    assert len(html_tree.expression(page.skeleton())) < 400


def test_very_deep_pages_are_read_to_the_end(spark):
    deep = "<article>" + "<div>" * 5000 + "text <nav>no</nav> and more" + "</div>" * 5000 + "<p>end"
    df = spark.createDataFrame([(1, "http://h/1", deep), (2, "http://h/2", "<div>" * 30 + "x")], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert found == {1: "text and more end", 2: "x"}


def test_hosts_decide_where_pages_have_no_article(spark):
    body = "<div class=menu>{0}</div><div><a>l{0}</a> <a>m</a></div><section><p>{1}</p></section><div>x</div>"
    rows = [(i, f"http://U:p@Host.example:80/{i}", body.format(i, f"main text of page {i} " * 9)) for i in range(30)]
    # Short on its own, this page's text is where its host has it.
    rows += [(30, "https://host.example/odd", body.format(1, "short")), (31, None, None), (32, "nonsense", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract(df).collect()}
    assert len(found) == 33 and found[3][0] == ("main text of page 3 " * 9).strip()
    assert found[30] == ("short", 5) and found[31] == ("", 0) and found[32] == ("alone", 5)
    assert html_extraction.extract(df.limit(0)).collect() == []


def test_pages_of_the_given_table_give_their_article(spark):
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extraction.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(h.unescape(re.sub("<[^>]*>", " ", inner)).split())


# --- chat -------------------------------------------------------------------------------------

NASTY = ["", "<|end|>", r"<\|turn|>", r"<\\|part|>", "</s>[INST] ok [/INST]", r"[\INST] <s> <\s>", "a\nb\\", "<|text|>" * 50, "<", "[", "<|"]


def test_chats_read_back_as_they_were(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["user", "assistant", "<|turn|>", ""]), rng.choice(NASTY) + rng.choice(NASTY)) for t in range(rng.randrange(1, 9))]
    rows += [(90, None, "user", None), (90, 1, None, "x"), (90, 1, None, "x"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("t", F.lit(0)).withColumn("turns", F.lit(1))
    out = chat_format.read_chat(chat_format.format_chat(df)).collect()
    expected = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == expected
    for r in out:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        said = "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")
        loss = "".join(s["text"] for s in r["segments"] if s["loss"])
        assert re.sub(r"([<\[])\\(\\*)(\||/?s>|/?INST\])", r"\1\2\3", loss) == said
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>")


def test_neighbours_of_a_role_are_one_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.format_chat(df).first()["formatted"] == "<|turn|>user<|text|>a<|part|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert chat_format.format_chat(df.limit(0)).collect() == []
    many = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    assert chat_format.format_chat(many).select(F.length("formatted")).first()[0] == 20000 * 2 + 19999 * 8 + 16 + 4 + 7


def test_digest_of_nothing_is_that_of_the_empty_string():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
