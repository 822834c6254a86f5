"""Pages whose article lies in forms or marked wrappers, deep nesting, roles of any length."""

import time

import pytest

from fallpoint.llm import chat_format, html_extract

STORY = "<h1>Title</h1><p>First long paragraph of the story, with words.</p><p>Second one.</p>"
WANT = "Title\nFirst long paragraph of the story, with words.\nSecond one."
THREAD = "<div id='comments'>" + "<article class='comment'><h1>Me</h1><p>I say a lot about it. </p></article>" * 20 + "<form><p>Reply</p></form></div>"


@pytest.mark.parametrize("html", [
    f"<form><article>{STORY}</article></form>",
    f"<form action='/x'><div class='menu'>Home</div><div id='main'>{STORY}</div><input name='q'></form>",
    f"<div class='page with-sidebar'><div class='content'>{STORY}</div><div class='sidebar'>side</div></div>",
    f"<div class='entry has-ads'>{STORY}<div class='ads'>Buy</div></div>",
    f"<div id='social-page'>{STORY}</div>",
    f"<div class='share shell'><article>{STORY}<div class='share'>Share it</div></article></div>",
    f"<div class='promo'><div class='banner'><main>{STORY}</main></div></div><p>by us</p>",
    f"<div class='content'>{STORY}</div>{THREAD}",
    f"<div class='with-sidebar'>{STORY}{THREAD}</div>",
])
def test_article_in_marked_wrappers(html):
    assert html_extract.Page(html).text(None) == WANT


@pytest.mark.parametrize("html", ["<div class='cookie-notice'><p>We use cookies on this site.</p></div>", "<form><label>Name</label><p>Sign in here</p></form>", THREAD])
def test_nothing_but_notices(html):
    assert html_extract.Page(html).text(None) == ""


def test_deep_nesting_is_linear():
    def took(n):
        began = time.perf_counter()
        page = html_extract.Page("<div class='a'>x" * n)
        assert len(page.blocks) == n and page.text("no such path")
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 40 * took(4000) + 1


def test_roles_of_any_length(spark):
    roles = ["r" * 1_000_000, "a: b\\" * 20_000, ":" * 5000, "\\" * 5001]
    rows = [(k, 0, role, "text") for k, role in enumerate(roles)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["turns"] for r in chat_format.read_chats(chat_format.format_chats(data)).collect()}
    assert all([(t["role"], t["text"]) for t in got[k]] == [(role, "text")] for k, role in enumerate(roles))
