import hashlib
import json
import math
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, common, mixing, pii, queries, style_tree, tool_calls, toxicity

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def documents(spark):
    return common.table(spark, SF, "documents").collect()


# mixing


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(spark):
    rows = queries.op4_mixing(spark, SF).collect()
    assert sorted(rows) == sorted(queries.op4_mixing(spark, SF).collect())
    docs = {r["doc_id"]: r for r in documents(spark)}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
    want, most = fair_targets(sizes), max(r["size"] for r in rows)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    assert all(abs(taken[s] - want[s]) <= most / 2 + 1 for s in sizes)


def test_mixing_is_a_pareto_sample(spark):
    docs = common.table(spark, SF, "documents")
    sizes = mixing._sizes(docs, "doc_id", "text", "source", F.monotonically_increasing_id())
    ranked, plan, scales, _ = mixing._planned(sizes)
    scale = {r["source_"]: r["scale"] for r in scales.collect()}
    plans = {r["source_"]: r for r in plan.collect()}
    u = {r[0]: r[1] for r in docs.select("doc_id", ((F.pmod(F.xxhash64(F.lit(mixing.SEED), F.xxhash64("doc_id", "text")), F.lit(1 << 50)) + 0.5) / float(1 << 50))).collect()}
    by_source = defaultdict(list)
    for r in ranked.collect():
        by_source[r["source"]].append(r)
    for source, rows in by_source.items():
        own = plans[source]
        need = own["target"] - own["whole"] * own["source_size"]
        measure = {r["doc_id"]: 1 / (math.floor(math.log2(r["size"] + 1)) + 1) for r in rows}
        p = {r["doc_id"]: min(1, scale.get(source, 0) * measure[r["doc_id"]]) for r in rows}
        if need > 1e-6:
            assert abs(sum(p[r["doc_id"]] * r["size"] for r in rows) - need) < 1e-6 * need
        # a document is taken if its random odds over its inclusion odds are among the least that meet the need
        q = {r["doc_id"]: 0 if p[r["doc_id"]] >= 1 else u[r["doc_id"]] / (1 - u[r["doc_id"]]) * (1 - p[r["doc_id"]]) / max(p[r["doc_id"]], 1e-300) for r in rows}
        took = [r for r in rows if r["rank"] <= own["cut"]]
        left = [r for r in rows if r["rank"] > own["cut"] and r["size"]]
        assert not took or not left or max(q[r["doc_id"]] for r in took if r["size"]) <= min(q[r["doc_id"]] for r in left) * (1 + 1e-6)


def test_mixing_breaks_ties_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 40 + [(2, "x", "b")] * 200, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    target, taken = {r["doc_id"]: r["target"] for r in rows}, defaultdict(int)
    for r in rows:
        taken[r["doc_id"]] += r["taken"]
    assert all(abs(taken[k] - target[k]) <= 3 for k in target)
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows)


def test_mixing_odd(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


# personal data


def slow_spans(text):
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    patterns = {"email": pii._EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": pii._CARD, "phone": pii._PHONE}
    return [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in patterns[k].finditer(text) if good[k](m[0])]


def test_personal_data(spark):
    want = {r["doc_id"]: slow_spans(r["text"] or "") for r in documents(spark)}
    for r in queries.op5_pii(spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(want[r["doc_id"]]).encode()).hexdigest()
        assert set(want[r["doc_id"]]) <= set(r["spans"].split(",") if r["spans"] else [])
        assert r["n_email"] == sum(x.startswith("email") for x in want[r["doc_id"]])


def test_spans_equal_the_patterns():
    for text in ("a@b.c@d.ef @x.y a.b@c-d.e.f, 1.2.3.4.5 256.1.1.1 4111 1111-1111 1111x", "+1 (555) 123-4567 +12", "é@x.yy ..@a.b a@b", "x" * 3000 + "@y.zz"):
        assert [f"{k}:{s}:{e}" for k, x in pii.base_spans(text).items() for s, e in x] == slow_spans(text)


def test_contexts_discover_identifiers(spark):
    seeds = [(i, f"hello reach us by mailbox: user{i}@site.example.com today") for i in range(30)]
    docs = spark.createDataFrame([*seeds, (99, "hello reach us by mailbox: user(at)9999hidden today"), (98, "the year 19990 was good")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert found[99] == "email:27:45" and found[98] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[99] == "hello reach us by mailbox: [EMAIL] today" and clean[0] == "hello reach us by mailbox: [EMAIL] today"
    assert {r["doc_id"]: r["text"] for r in pii._redacted_by_join(docs, "text", "doc_id").collect()} == clean


def test_secrets_are_found_by_what_stands_before_them(spark):
    rng = np.random.default_rng(3)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f"some words token = \"{key()}\" and more") for i in range(12)]
    rows += [(50, "other words token = \"Zx99-11_22\" then"), (51, f"commit {key()} alone"), (52, "order 12345678 of the 1999 list"), (53, "of the 77777 list")]
    rows += [(100 + i, "of the ordinary words in the list") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["spans"] == "secret:20:60" and got[i]["n_spans"] == 1 for i in range(12))
    assert got[50]["spans"] == "secret:21:31" and not any(got[i]["spans"] for i in (51, 52, 53))


def test_contexts_on_the_table_add_spans(spark):
    found = pii.find(common.table(spark, "/root/testdata/sf0.01", "documents"))
    assert found.selectExpr("sum(size(more))").first()[0] >= 10


def test_hostile_texts_end_soon():
    import time

    start = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" * 300_000, "@" * 500_000, "a@" * 500_000, "\u6f22" * 1_000_000 + "1234"):
        base = [(k, s, e) for k, x in pii.base_spans(text).items() for s, e in x]
        list(pii.occurrences(text, base))
    assert time.perf_counter() - start < 20


def test_personal_data_odd(spark, odd_docs, no_docs):
    assert pii.personal_data(odd_docs).count() == odd_docs.count() and pii.personal_data(no_docs).count() == 0
    kept = pii.redacted(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text is null").count() == 2 and pii.redacted(no_docs).count() == 0


# pages


def test_pages(spark):
    for r in queries.op7_html(spark, SF).join(common.table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
        want = [re.sub(r"\s+", " ", style_tree.unescape(p)).strip() for p in parts]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_page_parts():
    page = "<head><title>T</title></head><body><header>H</header><nav><a>x</a></nav><main><h1>A &amp; B</h1><p>one <span class='ad'>buy</span> two<ul><li>i<li>j</ul><div id=comments>c</div><form>f</form><script>if(a<b){}</script><p>3 < 4 &am</main><aside>s</aside><footer>f"
    assert style_tree.main_text(page) == "A & B\none two\ni\nj\n3 < 4 &am"
    assert style_tree.main_text("") == "" and style_tree.main_text("plain\n text") == "plain text" and style_tree.main_text("<p>a<p>b") == "a\nb"


def test_site_tree_removes_what_all_pages_share(spark):
    rows = [(i, "http://h.example/x", f"<body><div class='top'>Same on every page</div><div class='story'>Story number {i}</div></body>") for i in range(12)]
    rows += [(50, "http://few.example/", "<div class='top'>Same on every page</div>"), (51, None, None), (None, "::", "")]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect()}
    assert got[3] == "Story number 3" and got[50] == "Same on every page" and got[51] == "" and got[None] == ""
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_behind_foreign_elements_and_in_containers_with_a_noise_word():
    text = style_tree.main_text
    assert text("<p>a<svg width='1' /> b</p><math/><p>c<svg><path/>x</svg>d</p>") == "a b\ncd"
    assert text("<body><nav>n</nav><div class='content has-sidebar'><article><p>Story</p></article><div class=sidebar>s</div></div><div class=related>longer than the story itself</div>") == "Story"
    assert text("<div class='elementor-widget-text-editor'><p>The whole long story</p><div class=share>s</div></div><div class=related>more</div>") == "The whole long story"
    assert text("<main><p>Story</p><div id=comments><article>a comment longer than it</article></div></main>") == "Story"
    assert text("<p>The story itself</p><div class=related><p>more</p></div>") == "The story itself"


def test_copies_of_a_page_count_once(spark):
    page = "<body><div class='top'>Top</div><div class='story'>{}</div></body>"
    rows = [(i, "http://copies.example/x", page.format("One story")) for i in range(50)]
    rows += [(100 + i, "http://most.example/x", page.format("One story" if i < 38 else f"Story {i}")) for i in range(40)]
    rows += [(200 + i, None, page.format("No host")) for i in range(20)]
    rows += [(300 + i, "http://site.example/x", page.format(f"Story {i // 3}")) for i in range(36)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(50)} == {"Top\nOne story"} and got[138] == "Top\nStory 38" and got[139] == "Top\nStory 39" and got[200] == "Top\nNo host"
    assert all(got[300 + i] == f"Story {i // 3}" for i in range(36))


# toxicity


def test_toxicity(spark, odd_docs, no_docs):
    docs = [(i, ("you idiot " if i % 4 == 0 else "kind ") + f"word{i % 7} some plain text") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1 for r in got) and any(r["held_out"] for r in got)
    assert toxicity.classify(odd_docs, labels).count() == odd_docs.count() and toxicity.classify(no_docs, labels).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.classify(odd_docs, labels.limit(0)).collect())


def test_counterfactuals_lower_the_score_of_neutral_mentions():
    rows = [(("gay", "awful", "scum"), 1)] * 30 + [(("scum", "you"), 1)] * 10 + [(("nice", "day"), 0)] * 160 + [(("gay", "pride"), 0)] * 2
    plain, fair = (toxicity.fit(rows, counterfactual=c).scorer()("a gay couple") for c in (0.0, 5.0))
    assert fair < plain and toxicity.fit(rows, counterfactual=5.0).scorer()("you scum") > 0.5


# byte-level BPE


def test_bpe(spark, odd_docs, no_docs):
    for docs in (common.table(spark, SF, "documents"), odd_docs):
        got = sorted(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect(), key=str)
        want = []
        for r in docs.collect():
            ids = OWN.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert list(map(tuple, got)) == sorted(want, key=str) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(no_docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_white_space():
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), np.random.default_rng(2)
    signs = list(" \n\t\r\x1c\x85\xa0　 ab1!é漢's'▁,.") + ["  ", "the", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(signs, rng.integers(0, 12)))
        ids = codec.encode(text)
        assert ids.tolist() == OWN.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_article_text_is_kept_whole():
    text = style_tree.main_text
    assert text('<article><h1>T</h1><p class="related work">a</p><p class="notice">b</p><div class="social science">c</div><div class="ad">buy</div></article>') == "T\na\nb\nc"
    assert text("<article>teaser</article><div class=story><p>A much longer body than that</p></div>") == "teaser\nA much longer body than that"
    assert text("<p>a\u2003\u3000b\x1cc</p>") == "a b c"
    assert text('<p>x<a href="y>z</a> w</p><p>v') == "xz w\nv" and text("<p title=a\"b>x</p>") == "x" and text("<a 'b>x</a>") == "x"


def test_hostile_pages_end_soon():
    import time

    start = time.perf_counter()
    for page in ('<a "' * 50_000, "<div>" * 50_000 + "x", "<b>" * 20_000 + "<p>x</p>" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, '<a x="' * 50_001, "<!--" * 100_000, "<" * 100_000, "<a x= " * 50_000, "</" * 100_000, "<p>" * 50_000):
        style_tree.main_text(page)
        style_tree.styles_of(page)
    assert time.perf_counter() - start < 30


def test_trees_of_the_table_hold_all_nodes(spark):
    pages = common.table(spark, SF, "pages")
    nodes = pages.select("url", common.text_of("html").alias("html")).mapInArrow(style_tree._nodes, style_tree._NODES).distinct()
    slow = set()
    for r in pages.collect():
        blocks = [(b.path, x) for b in style_tree.blocks_of(r["html"] or "") if (x := style_tree.block_text(b))]
        page = style_tree._digest("\n".join(f"{p}\n{x}" for p, x in blocks))
        slow |= {(style_tree._host(r["url"]), p, False, style_tree._digest(x), page) for p, x in blocks}
        slow |= {(style_tree._host(r["url"]), p, True, style_tree._digest(x), page) for p, found in style_tree.styles_of(r["html"] or "").items() for x in found}
    assert set(map(tuple, nodes.collect())) == slow and len(slow) > 1_000
    assert any("nav" in x[1] for x in slow) and any("article" in x[1] for x in slow)
    want = {}
    for host, path in {x[:2] for x in slow if not x[2]}:
        own = [x for x in slow if x[:2] == (host, path)]
        texts, shapes = [x for x in own if not x[2]], [x for x in own if x[2]]
        n = len({x[4] for x in texts})
        count = lambda rows: [sum(x[3] == f for x in rows) for f in {x[3] for x in rows}]
        base = math.log(max(n, 2))
        content = 1 - sum(c * math.log(c) for c in count(texts)) / len(texts) / base
        shape = min(1, max(0, sum(-c / len(shapes) * math.log(c / len(shapes)) for c in count(shapes)) / base)) if shapes else 0
        want[host, path] = style_tree.GAMMA * content + (1 - style_tree.GAMMA) * shape
    got = {(r["host"], r["path"]): r["importance"] for r in style_tree.importance(nodes).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# toxicity on the table


def test_held_out_quality_and_penalty(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = toxicity.classify(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert len(toxic) > 50 and sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    wins = sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.93
    fair, plain = (toxicity.train(docs, labels, counterfactual=c) for c in (1.0, 0.0))
    terms = {t for g in toxicity.IDENTITY_TERMS for t in g}
    size = lambda m: sum(w * w for f, w in m.weights.items() if f in terms)
    assert size(plain) > 0 and size(fair) < 0.5 * size(plain)


# tool calls


def test_tool_calls(spark):
    schema = {"f": {"required": ["a"], "properties": {"a": "integer", "b": "string"}, "additional": False}}
    calls = [(1, "x", "f", '{"b": "t", "a": 1}', None), (1, "y", "f", '{"a":"1","c":2}', "x"), (1, "z", "g", "{}", "y"), (1, "p", "f", "[1]", "q"), (1, "q", "f", "nope", "p"), (2, "x", "f", '{"a":2}', "gone"), (None, "n", "f", '{"a":2}', None), (2, "x", "f", '{"a":3}', "gone")]
    results = [(1, "x", 'say "hi"'), (1, "x", "zz"), (1, "lost", "r"), (None, "n", "r")]
    got = {(r["group_id"], r["call_id"], r["status"]): r for r in tool_calls.link(spark.createDataFrame(calls, "group_id long, call_id string, name string, arguments string, after string"), spark.createDataFrame(results, "group_id long, call_id string, content string"), schema).collect()}
    spare = {k: (json.loads(got.pop(k)["json"])) for k in [(1, "x", "duplicate"), (2, "x", "duplicate")]}
    assert spare[1, "x", "duplicate"]["result"] == "zz" and spare[2, "x", "duplicate"]["arguments"] == {"a": 3}
    assert {k: v["level"] for k, v in got.items()} == {(1, "x", "linked"): 0, (1, "y", "unanswered"): 1, (1, "z", "unanswered"): 2, (1, "p", "cycle"): None, (1, "q", "cycle"): None, (2, "x", "unanswered"): 0, (None, "n", "unanswered"): 0, (1, "lost", "orphan"): None, (None, "n", "orphan"): None}
    assert got[1, "x", "linked"]["json"] == '{"arguments":{"a":1,"b":"t"},"id":"x","name":"f","result":"say \\"hi\\""}' and got[1, "x", "linked"]["errors"] == []
    assert got[1, "y", "unanswered"]["errors"] == ["a: not integer", "c: unknown"] and got[1, "z", "unanswered"]["errors"] == ["unknown tool"]
    assert got[1, "p", "cycle"]["errors"] == ["not an object"] and got[1, "q", "cycle"]["errors"] == ["not JSON"]


def test_conversations(spark):
    turns = common.table(spark, SF, "conversations").collect()
    users = {(r["conv_id"], r["turn"]): r["text"] for r in turns if r["role"] == "user"}
    answers = {(r["conv_id"], r["turn"] - 1): r["text"] for r in turns if r["role"] == "assistant"}
    whole = queries.op10_tool_calls(spark, SF).collect()
    rows = [r for r in whole if r["status"] != "message"]
    assert len(rows) == len(users.keys() | answers.keys()) and sum(r["copies"] for r in whole if r["status"] == "message") == sum(r["role"] not in ("user", "assistant") for r in turns)
    for r in rows:
        at = tuple(map(int, r["call_id"][1:].split("-", 1)))
        level, back = 0, at
        while (back := (back[0], back[1] - 2)) in users and at in users:
            level += 1
        body = json.loads(r["json"])
        assert body["result"] == answers.get(at)
        if at in users:
            assert (r["level"], r["errors"]) == (level, "") and body["arguments"] == {"turn": at[1], "text": users[at]}
    chain = spark.createDataFrame([(7, t, "user", "u") for t in range(0, 4000, 2)], "conv_id long, turn long, role string, text string")
    assert tool_calls.link_conversations(chain).agg(F.max("level")).first()[0] == 1999


# pipeline


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        docs = out
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert got.count() == docs.count() > 0


def test_run_against_plain_python(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 7)) for _ in range(4000)]
    texts = {i: " ".join(rng.choice(words, 60)) for i in range(240)}
    toxic = {i for i in texts if i % 6 == 0}
    copies = {i: i - 20 for i in range(200, 240) if i not in toxic and i - 20 not in toxic and i < 220}
    for i in toxic:
        texts[i] = f"you idiot scum {texts[i]} idiot scum"
    for i in range(1, 200, 7):
        texts[i] += f" name{i}@mail.example.com"
    for i, j in copies.items():
        texts[i] = texts[j]
    docs = [(i, x, "abcd"[i % 3 if i % 5 else 3]) for i, x in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in texts], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = {i: s for i, _, s in docs}

    stages, at, sf = {}, common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.cut(stage(spark, at, sf))
        stages[name] = [(r["doc_id"], r["text"]) for r in at.collect()]
    clean = {i: x for i, x in texts.items() if i not in toxic}
    assert sorted(stages["toxicity"]) == sorted(clean.items())
    single = {i: x for i, x in clean.items() if i not in copies}
    assert copies and sorted(stages["simhash_near_duplicates"]) == sorted(single.items())
    masked = {i: re.sub(r"\S+@\S+", "[EMAIL]", x) for i, x in single.items()}
    assert masked != single and sorted(stages["personal_data"]) == sorted(masked.items())
    mix, sizes, taken = stages["source_mixing"], defaultdict(int), defaultdict(int)
    for i, x in masked.items():
        sizes[source[i]] += len(x.split())
    for i, x in mix:
        assert x == masked[i]
        taken[source[i]] += len(x.split())
    times = {s: {sum(j == i for j, _ in mix) for i in masked if source[i] == s} for s in sizes}
    want, most = fair_targets(sizes), max(len(x.split()) for x in masked.values())
    assert all(abs(taken[s] - want[s]) <= most / 2 + 1 and max(times[s]) - min(times[s]) <= 1 for s in sizes)
    rows = []
    for i, x in mix:
        ids = OWN.encode_ordinary(x)
        rows.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(rows)


def test_odd_turns_and_repeats(spark, no_docs):
    long = "w " * 200_000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", long), (1, None, "user", "x"), (None, 2, "user", "y"), (1, 3, None, "z"), (1, 4, "tool", None), (1, 4, "tool", None), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as group_id", "1 as copies", "'q' as status", "2 as level")
    got = sorted(((r["conv_id"], r["call_id"], r["status"], r["copies"]) for r in tool_calls.link_conversations(turns).collect()), key=str)
    assert got == sorted([(1, "c1-0", "linked", 1), (1, "c1-0", "duplicate", 1), (1, "c1-0", "duplicate", 1), (1, None, "unanswered", 1), (None, None, "unanswered", 1), (1, "c1-3", "message", 1), (1, "c1-4", "message", 2), (2, "c2-0", "message", 1)], key=str)
    assert tool_calls.link_conversations(turns.limit(0)).count() == 0


def test_numbers_have_one_form(spark):
    rows = [('{"b": 1e2, "a": 100}', '{"a":100,"b":100}'), ('{"x": 1.50, "y": -0, "s": "1e2 \\" 1.0"}', '{"s":"1e2 \\" 1.0","x":1.5,"y":0}'), ("[1.0, 2, 3.25e1]", "[1,2,32.5]"), ("{", None), ('{"a":1,"a":2}', None), ("1E400", None)]
    found = spark.createDataFrame([(a,) for a, _ in rows[:5]], "j string").select("j", tool_calls.canonical(F.col("j")).alias("c"))
    got = {r["j"]: r["c"] for r in found.collect()}
    assert got == dict(rows[:5])


def test_calls_that_need_several(spark):
    rows = [(1, "a", None), (1, "b", ["a"]), (1, "c", ["a", "b"]), (1, "d", ["c", "gone"]), (1, "e", ["f"]), (1, "f", ["e"]), (1, "g", ["e", "a"])]
    calls = spark.createDataFrame(rows, "group_id long, call_id string, after array<string>")
    got = {r["call_id"]: r["level"] for r in tool_calls.order_calls(calls).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "f": None, "g": None}
    linked = tool_calls.link(calls.selectExpr("*", "'f' as name", "'{}' as arguments"), spark.createDataFrame([(1, "a", "r")], "group_id long, call_id string, content string"), {"f": {}})
    assert {r["call_id"]: r["status"] for r in linked.collect()} == {"a": "linked", "b": "unanswered", "c": "unanswered", "d": "unanswered", "e": "cycle", "f": "cycle", "g": "cycle"}
