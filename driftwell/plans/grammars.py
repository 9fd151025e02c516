"""The ready-made grammars: what each draws from the corpus, and how it speaks of it."""

from __future__ import annotations

from driftwell.plans.grammar import Grammar

#: name: (count, symbols filled from the corpus, sentences)
READY = {
    "contradictor": (1, {"note": "$vault.random_note_title()"}, ["#note# holds. What would make it fail?", "Argue against #note# for a page.", "Whom does #note# leave out?"]),
    "hub_explorer": (2, {"hub": "$vault.hubs(2)"}, ["Much leads to #hub#. What does it gather?", "Could #hub# be two notes?", "What would be missing without #hub#?"]),
    "note_combinations": (2, {"one": "$vault.sample_notes(2)", "other": "$vault.sample_notes(2)"}, ["Put #one# beside #other#: what appears?", "What would #one# ask of #other#?"]),
    "orphan_connector": (1, {"orphan": "$vault.orphans(1)"}, ["#orphan# stands alone. Where would it fit?", "What single link would bring #orphan# in?"]),
    "perspective_shifter": (2, {"note": "$vault.sample_notes(2)"}, ["Read #note# as a beginner would.", "How will #note# look in ten years?", "Tell #note# from the other side."]),
    "questioning_mind": (1, {"note": "$vault.questioning_notes(1)"}, ["#note# asks much. Which question is still open?", "Answer one question of #note# today."]),
    "random_prompts": (2, {"verb": None, "thing": None}, ["#verb.capitalize# #thing.a# that you have avoided.", "What would happen if you could not #verb# any #thing#?"]),
    "semantic_neighbours": (2, {"cluster": "$vault.semantic_clusters(2, 3)"}, ["Near #seed#: #others#. What joins them?", "#seed# keeps company with #others#. Is that chance?"]),
    "temporal_contrast": (1, {"past": "$vault.past_focused_notes(1)", "future": "$vault.future_focused_notes(1)"}, ["#past# looks back and #future# ahead. Do they speak of one thing?"]),
    "transformation_suggester": (3, {"note": "$vault.sample_notes(3)"}, ["Turn #note# into a list.", "Draw #note#.", "Cut #note# to three sentences."]),
    "unexpected_neighbour": (1, {"note": "$vault.surprising_notes(1)"}, ["#note# is unlike the rest. Why is it here?", "What does #note# know that others do not?"]),
    "what_if": (3, {"note": "$vault.sample_notes(3)"}, ["What if #note# came first?", "What if the opposite of #note# were true?", "What if #note# were about you?"]),
}
WORDS = {"verb": ["finish", "explain", "shrink", "lend"], "thing": ["idea", "promise", "draft", "habit"]}


def ready(name: str) -> Grammar:
    count, filled, sentences = READY[name]
    rules = {"origin": list(sentences)} | {k: [v] if v else list(WORDS[k]) for k, v in filled.items()}
    if name == "semantic_neighbours":
        rules |= {"seed": ["#cluster.split_seed#"], "others": ["#cluster.split_neighbours#"]}
    return Grammar(name, rules, count)
