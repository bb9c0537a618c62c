"""Operators whose inputs the tables don't hold, over literal rows with the results they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dunecorpus.functions import arabizi, captured, forum, ids, text
from dunecorpus.operators import selecting
from dunecorpus.sources import readers

CASES = {}


def golden(name: str, schema: str, inputs: list, make, columns: list[str], results: list[tuple], types: str = "") -> None:
    """``make`` over the literal inputs has to give the literal results."""
    CASES[name] = (schema, inputs, make, columns, results)


@pytest.fixture
def written(spark, tmp_path):
    """A file of these lines."""

    def put(lines: list[str]) -> str:
        (tmp_path / "file").write_text("\n".join(lines) + "\n")
        return str(tmp_path / "file")

    return put


# The inputs and results below state the specified behaviour.
# Addresses of videos, channels and profiles.
VIDEOS = {
    "https://www.youtube.com/watch?v=dQw4w9WgXcQ": "dQw4w9WgXcQ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=30s": "dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ": "dQw4w9WgXcQ",
    "https://youtu.be/dQw4w9WgXcQ?si=abc123": "dQw4w9WgXcQ", "https://www.youtube.com/shorts/dQw4w9WgXcQ": "dQw4w9WgXcQ", "https://www.youtube.com/embed/abc-DEF_123/": "abc-DEF_123", " dQw4w9WgXcQ ": "dQw4w9WgXcQ",
}
golden("p21_video_ids", "url string", [(u,) for u in VIDEOS], lambda t: t.select("url", ids.video_id(F.col("url")).alias("video_id")), ["url", "video_id"], list(VIDEOS.items()))

CHANNELS = {
    "https://www.youtube.com/@Ennahartvonline/": (None, "@Ennahartvonline"), "https://www.youtube.com/@Ennahartvonline": (None, "@Ennahartvonline"), "https://www.youtube.com/channel/UC57OCoLoU6zAtBdJOmwg2vA": ("UC57OCoLoU6zAtBdJOmwg2vA", None),
    "https://www.youtube.com/c/SomeChannel": (None, "@SomeChannel"), "UC57OCoLoU6zAtBdJOmwg2vA": ("UC57OCoLoU6zAtBdJOmwg2vA", None), "@example_channel": (None, "@example_channel"), "example_channel": (None, "@example_channel"),
}
golden("p22_channel_refs", "url string", [(u,) for u in CHANNELS], lambda t: t.select("url", ids.channel_ref(F.col("url")).alias("c")).select("url", "c.*"), ["url", "channel_id", "handle"], [(u, *c) for u, c in CHANNELS.items()])

USERS = {"https://www.tiktok.com/@some.user?lang=ar": "some.user", "tiktok.com/@u1/video/7": "u1", "@plain": "plain", " bare/ ": "bare"}
golden("p23_usernames", "raw string", [(u,) for u in USERS], lambda t: t.select("raw", ids.username(F.col("raw")).alias("username")), ["raw", "username"], list(USERS.items()))

# Captured requests.
COOKIE = "cf_clearance=aB.c=1; bbsessionhash=77;  empty; x = y "
golden("p24_cookie_values", "header string", [(COOKIE,), ("",), (None,)], lambda t: t.select("i", F.inline(ids.cookies(F.col("header")))), ["i", "name", "value"], [(0, "cf_clearance", "aB.c=1"), (0, "bbsessionhash", "77"), (0, "x", "y")], "INT VARCHAR VARCHAR")
COMMANDS = [
    ("curl 'https://a.test/x?y=1' \\\n  -H 'accept: text/html' \\\n  -b 'k=v; k2=v2' \\\n  -H 'User-Agent: Mozilla/5.0 (X11)' --compressed",), ('curl --cookie "a=b" -A "agent 7" https://a.test',),
    ("curl https://a.test -H 'user-agent: z'",), ("curl 'unclosed",), (None,),
]
golden("p25_copied_commands", "command string", COMMANDS, lambda t: t.select("i", captured.command_parts(F.col("command")).alias("c")).select("i", "c.*"), ["i", "cookie_header", "user_agent"], [(0, "k=v; k2=v2", "Mozilla/5.0 (X11)"), (1, "a=b", "agent 7"), (2, None, None), (3, None, None), (4, None, None)], "INT VARCHAR VARCHAR")
# Forum pages.
INDEX = """<html><body><table>
<tr><td class="tcat" colspan=3><a href="#top"><img src=x></a><a href="forumdisplay.php?f=10&s=1">Group <b>One</b></a></td></tr>
<tbody id="collapseobj_forumbit_10"><tr><td id="f11"><a href="forumdisplay.php?f=11"><img src="i.gif"></a><a href="forumdisplay.php?f=11">First &amp; best</a><br>
sub: <a href="forumdisplay.php?f=12">Inner</a>, <a href="forumdisplay.php?f=11">again</a></td></tr></tbody>
<tr><td class="tcat">last topics</td></tr><tr><td class="x tcat"><a href="forumdisplay.php?f=20"></a></td></tr>
<tr><td class="tcat"><a href="forumdisplay.php?f=30">Group Two</a><tr><td><a href="showthread.php?t=5">no forum</a>
</table></body></html>"""
LISTING = """<table><tr><td><a href="showthread.php?t=501" id="thread_title_501">Thread &quot;A&quot;</a> <a href="showthread.php?t=501&page=2">2</a></td></tr>
<tr><td><a id="thread_title_502" href="x"><span>B</span> b</a><a id="thread_title_501">copy</a><a id="thread_title_503"> </a></td></tr></table>
<div class="pagenav big"><a rel="prev" href="p">1</a><a rel="next" href="n">3</a></div>"""
THREAD = """<table id="post9001"><tr><td class="thead">#1 2023-04-05, 16:07 <a>x</a></td></tr><tr><td><a class="bigusername" href="m"><b>Amina</b></a>
<table id="table52"><tr><td>nested</td></tr></table><div id="post_message_9001">first line<br>second <i>line</i><script>var no;</script><div> third </div></div></td></tr></table>
<table id="post9002"><tr><td class="thead">deleted</td></tr><tr><td><div id="post_message_9002">guest</div></td></tr></table>
<table id="post9003"><tr><td><div id="post_message_9003"> <img src=x> </div></td></tr></table><table id="postmenu"><tr><td>no</td></tr></table>
<a rel="next" href="outside">next</a>"""
PAGES = [(INDEX,), (LISTING,), (THREAD,), ("<p>Access Denied</p>",), ("<p>عذرا، ليس لديك الصلاحية للدخول</p>",), (None,)]


def _items(read):
    return lambda t: t.select("i", F.posexplode(read(F.col("html"))).alias("place", "x")).select("i", "place", "x.*")


golden("h1_categories", "html string", PAGES, _items(forum.categories), ["i", "place", "id", "title"], [(0, 0, "10", "GroupOne"), (0, 1, "30", "Group Two")], "INT INT VARCHAR VARCHAR")
golden("h2_forums", "html string", PAGES, _items(forum.forums), ["i", "place", "id", "title"], [(0, 0, "10", "GroupOne"), (0, 1, "11", "First & best"), (0, 2, "12", "Inner"), (0, 3, "30", "Group Two")], "INT INT VARCHAR VARCHAR")
golden("h3_threads", "html string", PAGES, _items(forum.threads), ["i", "place", "id", "title"], [(1, 0, "501", 'Thread "A"'), (1, 1, "502", "Bb")], "INT INT VARCHAR VARCHAR")
golden("h4_posts", "html string", PAGES, _items(forum.posts), ["i", "place", "id", "author", "written", "body"], [(2, 0, "9001", "Amina", "2023-04-05, 16:07", "first line\nsecond\nline\nthird"), (2, 1, "9002", None, None, "guest")], "INT INT VARCHAR VARCHAR VARCHAR VARCHAR")
golden("h5_has_next", "html string", PAGES, lambda t: t.select("i", forum.has_next(F.col("html")).alias("more")), ["i", "more"], [(0, False), (1, True), (2, False), (3, False), (4, False), (5, False)], "INT BOOLEAN")
golden("h6_category_scope", "html string", PAGES, _items(lambda h: forum.forums(h, "10")), ["i", "place", "id", "title"], [(0, 0, "11", "First & best"), (0, 1, "12", "Inner")], "INT INT VARCHAR VARCHAR")
golden("f11_refused_pages", "html string", PAGES, lambda t: t.where(forum.refused(F.col("html"))), ["i"], [(3,), (4,)], "INT")

# Other letters, byte pieces.
RENDERED = {
    "في": "fi", "راني": "rani", "الدار": "eldar", "كتاب": "ktab", "سلام": "slam", "يبارك": "ybark", "شرب": "chrb", "نور": "nour", "حوت": "7out", "قلب": "9lb", "ال": "al", "بيت وولد": "bit wwld", "دوا": "dwa", "مدرسة": "mdrst", "جزء": "jz",
    "راني عارف، عليهم في الدار!": "rani 3arf، 3lihm fi eldar!", "wach كاين x2 😂 2مع": "wach kayen x2 😂 2مع",
}
golden("m15_transliteration", "text string", [(x,) for x in RENDERED], lambda t: t.select("text", arabizi.transliterate(F.col("text")).alias("latin")), ["text", "latin"], list(RENDERED.items()))
PIECES = {"▁wach|▁ra|k": "wach rak", "▁<0xF0>|<0x9F>|<0x98>|<0x82>|▁ok": "😂 ok", "<0xFF>|a": "�a", "": ""}
golden("m19_byte_view", "pieces string", [(x,) for x in PIECES], lambda t: t.select("pieces", captured.byte_view(F.split(F.replace("pieces", F.lit("▁<"), F.lit("▁|<")), "\\|")).alias("text")), ["pieces", "text"], list(PIECES.items()))

# What SQL has no words for.
CLEANED = {"c1_nfkc_forms": (text.nfkc, {"ﷲ": "الله", "ﻻ": "لا", "ﻣﻦ": "من", "ﻓﻲ": "في", "عـــيد 😂 شُكْرًا": "عـــيد 😂 شُكْرًا", "ﬁ ①": "fi 1"}), "c7_phrase_runs": (text.collapse_phrases, {"يا حبيبي يا روحي " * 5: "يا حبيبي يا روحي " * 2, "هه هه": "هه هه", "abcdefghijkl" * 3 + "x": "abcdefghijkl" * 2 + "x"}), "c8_word_runs": (text.collapse_words, {"تم " * 40: "تم تم ", "لا لا لا نروح": "لا لا لا نروح", "x go go go go go home": "x go go home", "gogo go go go go go": "gogo go", "a\nb b b  b b c": "a\nb b c"})}
for _name, (_f, _cases) in CLEANED.items():
    golden(_name, "text string", [(x,) for x in _cases], lambda t, f=_f: t.select("text", f("text").alias("left_over")), ["text", "left_over"], list(_cases.items()))

# A forum tree with a cycle, a forum linked twice and one that nothing reaches.
LINKS = [("c1", 1, "f1"), ("c1", 2, "f2"), ("c2", 1, "f3"), ("f2", 1, "f4"), ("f3", 1, "f4"), ("f3", 2, "f5"), ("f4", 1, "f1"), ("f5", 1, "c1"), ("f5", 2, "f6"), ("z", 1, "f7")]
golden(
    "j12_forum_tree", "parent string, place int, child string", LINKS,
    lambda t: selecting.walk_tree(t.select("parent", "place", "child"), t.sparkSession.createDataFrame([("c1", 1, "One"), ("c2", 2, "Two")], "id string, place int, category string")),
    ["id", "parent", "category", "depth"],
    [("c1", None, "One", 0), ("c2", None, "Two", 0), ("f1", "c1", "One", 1), ("f2", "c1", "One", 1), ("f3", "c2", "Two", 1), ("f4", "f2", "One", 2), ("f5", "f3", "Two", 2), ("f6", "f5", "Two", 3)], "VARCHAR VARCHAR VARCHAR INT",
)


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal(spark, name):
    schema, inputs, make, columns, results = CASES[name]
    found = make(spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"i int, {schema}")).select(*columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(results, key=key)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_tolerant_json(spark, written):
    lines = ['{"doc_id": 1, "text": "good"}', '{"doc_id": 2, "text": "cut o', "", '{"doc_id": 3, "text": "a"}{"doc_id": 4, "text": "glued"}', "not json", '{"doc_id": 5, "text": null}']
    want = [(1, "good", None), (3, "a", None), (5, None, None), (None, None, '{"doc_id": 2, "text": "cut o'), (None, None, "not json")]
    assert rows(readers.json_lines(spark, written(lines), "doc_id long, text string"), "doc_id", "text", "_corrupt") == sorted(want, key=repr)


def test_labelled_csv(spark, written):
    assert rows(readers.labelled_csv(spark, written(["POS,very, very good", "no comma here", "NEG,no"])), "label", "text") == [("NEG", "no"), ("POS", "very, very good")]


def test_key_labels(spark, written):
    assert rows(readers.key_labels(spark, written(["ID\tlabel", "# sent_id = s1\tPOS", "# sent_id = s 2\tMIX"])), "key", "label") == [("s 2", "MIX"), ("s1", "POS")]


def test_treebank(spark, written):
    lines = ["# sent_id = s1", "# text = wach rak", "1-2\twachrak\t_\t_\t_\t_\t_\t_\t_\t_", "1\twach\t_\tADV\t_\t_\t_\t_\t_\tlang=ar|x", "2\trak\t_\tVERB\t_\t_\t_\t_\t_\t_", "", "# sent_id = s2", "# text = oui", "1\toui\t_\tINTJ\t_\t_\t_\t_\t_\tlang=fr_FR", "1.1\tx\t_\tX\t_\t_\t_\t_\t_\t_"]
    t = readers.treebank(spark, written(lines))
    assert rows(t.select("sent_id", "text", *[F.array_join(c, " ").alias(c) for c in ("forms", "tags", "langs")]), "*") == [("s1", "wach rak", "wach rak", "ADV VERB", "ar "), ("s2", "oui", "oui", "INTJ", "fr_FR")]


def test_settings(spark, written):
    lines = ["# seeds", "daily: 10000", "channels:", "  - '@one'", "  - two # the second", "state:", "  done: true", "  last:", "    id: 77"]
    assert readers.settings(spark, written(lines)) == {"daily": 10000, "channels": ["@one", "two"], "state": {"done": True, "last": {"id": 77}}}


def test_some_texts_are_augmented(spark):
    df = spark.createDataFrame([(i, "راني في الدار مع خويا واش كاين", "arabic" if i % 2 else "latin") for i in range(400)], "id long, text string, bucket string")
    got = df.select("id", "text", "bucket", arabizi.maybe_augment(F.col("text"), F.col("bucket"), F.col("id")).alias("new")).collect()
    changed = [r for r in got if r["new"] != r["text"]]
    assert all(r["bucket"] == "arabic" and sum(a != b for a, b in zip(r["text"].split(), r["new"].split(), strict=True)) == 1 for r in changed)
    assert 0.1 < len(changed) / 200 < 0.3
