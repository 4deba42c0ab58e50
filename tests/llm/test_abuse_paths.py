"""A remembered chunk gives the patterns the same words as a new one."""

from fieldwatch.llm.abuse import AbuseRule, Matcher, score_text


def test_words_of_clean_chunks():
    text = "Be sure that I'll kill you, I'll kill you."
    m = Matcher(AbuseRule(), frozenset())
    assert m.read("I'll") == ["i", "ll"]
    m.suspicious({"I'll"})
    assert m.clean["I'll"] == ["i", "ll"]
    first = score_text(text, m)
    assert first == score_text(text, m) == score_text(text, Matcher(AbuseRule(cache=0), frozenset())) and first[0] >= 0.8
