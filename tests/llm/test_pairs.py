import random

import pytest
from llm.declining import OTHERS, REFUSALS

from inkweave.llm import pairs as module
from inkweave.llm.pairs import Contexts, begun, broken_pairs, copied, ending, goes_on, language, open_quotation, prompt_language, said, unquoted
from inkweave.llm.queries import p3_found

SHOW = "show me the output of align_words for the payload about Fencreulm"
GERMAN = "Warum wurde die Idee über das Schema aus Fentarfayor abgelehnt?"


def words_of(text):
    return module.LETTERS.findall(text.lower())


def refused(text):
    return module.refused(unquoted(text), words_of(unquoted(text)))


def other_language(prompt, response):
    return module.other_language(prompt_language(prompt), unquoted(response), words_of(unquoted(response)))


def truncated(text, counts):
    found = module.truncated(text)
    return found if isinstance(found, bool) else goes_on(counts.get(found[0]), counts.get(found[1]), found[2])


def defect(prompt, response):
    found = module.defect(prompt, response, words_of(response or ""))
    return ("truncated" if goes_on(None, None, found[2]) else None) if isinstance(found, tuple) else found


def test_nothing_said():
    for text in ("", " \t\n", "​", "\xa0", "...", "…", "--", "null", "None", "N/A", "n.a.", "(empty)", "[]", "{}", '""', "NaN", "?!", "<null>", "Keine Angabe"):
        assert not said(text), text
    for text in ("Done", "OK", "No items yet", "6", "✅", "Nothing was lost.", "none of them"):
        assert said(text), text


def test_copies():
    for text in (SHOW, SHOW.upper(), f"  {SHOW}!! ", f"{SHOW}\n{SHOW}", f"You asked: {SHOW}", f"Q: {SHOW}?", f'Prompt - "{SHOW}"', f"> {SHOW}", SHOW.replace(" ", "  ")):
        assert copied(SHOW, text), text
    for text in (SHOW[:30], f"{SHOW} is done", f"You asked ‘{SHOW}’. There are 9 items.", "Here is what I found for Fencreulm.", ""):
        assert not copied(SHOW, text), text
    assert not copied("describe workflow", "The user asks about draft_outline, which matches the intent 'describe_workflow'.")
    assert copied("status", "Status.") and not copied("", "x") and not copied("?", "x")


def test_refusals():
    for text in (
        "I'm sorry, but I can't help with that request.", "As an assistant, I must decline the message you sent.", "I’d rather not give an answer to that.", "You will need a human for this; I am declining.",
        "My rules do not let me respond to messages like yours.", "It is not something I may comment on.", "Leider darf ich zu Quo keine Auskunft geben.", "Diese Frage kann ich als Assistent nicht beantworten.",
        "Je ne peux pas vous aider.", "Je dois refuser cette demande, car elle va contre mes règles.", "Lo siento, pero no puedo ayudarte con eso.", "Debo rechazar esta petición porque va contra mis normas.",
        "I am unable to assist with this.", "I'm not able to discuss that topic.", "We cannot answer this question.", "Ich muss diese Bitte leider ablehnen.",
        "This topic is off limits for me, so let us talk about something else.", "No comment from my side.", "It would be wrong of me to respond.", "That falls outside what I am permitted to discuss.",
        "Let us not go there.", "Por desgracia no me está permitido responder.", "Das ist mir leider nicht gestattet.", "Il ne m'est malheureusement pas permis de répondre.",
    ):
        assert refused(text), text
    for text in (
        "Cannot export yet: the desert is still blocked by choose_asset.", "I could not find an item named Tegalcas, so I listed the recent ones.", "Sorry for the delay, check_captions has now finished.",
        "The step is missing.", "Without the theatre, Loib cannot frame the shared tempos.", "No puedo encontrar el elemento Quo.", "Ich kann den Eintrag nicht finden.", "The idea was rejected by the desk.",
        "The note reads “I can't help with that request” and was kept.", "We can answer this.",
    ):
        assert not refused(text), text


def test_ways_to_decline_not_seen_before():
    """When first run: 65 of the 67 refusals were found, and 1 of the 29 others taken for one."""
    assert [t for t in REFUSALS if not refused(t)] == [] and [t for t in OTHERS if refused(t)] == []


def test_languages():
    assert language("Hier ist das Ergebnis für Loshosho.") == "de" and language("El paso va después de otro y guarda el resumen.") == "es"
    assert language("Voici le résultat pour Lotepacre, et le décor manque.") == "fr" and language("Approved") is None
    assert other_language(SHOW, "Hier ist das Ergebnis für Loshosho.") and other_language("status", "Es gibt 3 Einträge, und 2 davon sind freigegeben.")
    assert not other_language(GERMAN, "Hier ist das Ergebnis für Loshosho.") and not other_language(SHOW, "Done")
    assert not other_language(SHOW, "The title is „Die stille Werkstatt“, and score_clips keeps it as it is.")
    assert not other_language(SHOW, "Here is what I found for you. Hier ist das Ergebnis für Quo und das Archiv.")
    assert other_language(SHOW, "Это очень длинный ответ на другом языке")
    for text in (
        "Här är resultatet för steget, och det är klart.", "Oto wynik tego kroku, który jest już gotowy, ale nie dla wszystkich.", "Ecco il risultato per questo elemento, che non è ancora approvato.",
        "Aqui está o resultado para este item, que ainda não foi aprovado.", "Hier is het resultaat voor dit onderdeel, maar het is nog niet klaar.", "Tady je výsledek pro tento krok, ale ještě není hotový.",
        "Tämä vaihe on valmis, mutta se ei ole vielä hyväksytty.", "Ez a lépés már kész, de még nem hagyták jóvá.", "Bu adım tamamlandı ve bir sonraki için hazır, ama daha onay yok.",
        "Acesta este rezultatul pentru acest pas, dar nu este încă aprobat.", "Her er resultatet for trinnet, og det er ikke færdigt endnu, men det kommer.",
    ):
        assert other_language(SHOW, text) and other_language(GERMAN, text), text


def test_truncation():
    seen = {begun(t.split()): n for t, n in {"the message": (100, 1), "the message names": (100, 1), "no items yet": (40, 40)}.items()}
    assert not goes_on((5, 2), None, False) and goes_on((5, 1), None, False) and goes_on(None, (5, 1), False, True) and not goes_on((2, 0), (2, 0), False)
    for text in (
        "There are 3 items, and", "Here is it. Why would a", "Here it is. We open 66 maps", "The message names", "The note reads: “Between the faded furnace.", '```json\n{"step": "x", "note": "Our mask ac', '{"a": [1, 2',
        "It is done. And …", "Steps:\n- a,", "```\ncode", "This is (not closed.", "Il y a 13 éléments, et 58", 'He said "go.',
    ):
        assert truncated(text, seen), text
    for text in (
        "Done", "Approved ✅", "No items yet", "Steps:\n- align_words\n- render_preview", '```json\n{"step": "x", "numbers": [2, 7]}\n```', '{"ok": true}', "6", "export_bundle", "It is done.", "He said “go.”",
        "We adapt 3 rafts. (One by one)", "You asked ‘status’. It is fine!", "Is it?", "The title is „Die Werkstatt“.",
    ):
        assert not truncated(text, seen), text
    assert open_quotation("«a") and not open_quotation("„a“ “b” it's don’t")


def test_order_and_nulls():
    assert defect(None, None) == "empty" and defect(None, "It is done.") is None
    assert defect(GERMAN, "I can't help with that request, and") == "refusal"
    assert defect(GERMAN, "The step runs after this and keeps the") == "other_language"


def test_rows(spark):
    rows = [(1, "f", "p", None), (1, "f", "p", None), (2, "f", None, "Fine."), (3, "g", "list items", "List items!"), (None, "f", "p", ""), (4, "f", SHOW, "x " * 200_000 + "and")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, field_name string, prompt string, response string, defect int")
    got = [tuple(r) for r in broken_pairs(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "f", "empty"), (3, "g", "copied"), (None, "f", "empty"), (4, "f", "truncated")], key=str)
    assert broken_pairs(df.limit(0)).count() == 0


def test_query(spark, data):
    got = p3_found(spark, data).collect()
    assert len(got) == len({(r.trace_id, r.field_name) for r in got})
    assert {r.defect for r in got} == {"empty", "copied", "refusal", "other_language", "truncated"}
    assert {r.field_name for r in got} == {"agent_response", "reasoning"}
    found = {(r.trace_id, r.field_name): r.defect for r in got}
    word = module.WORD
    for r in spark.read.parquet(f"{data}/eval_traces.parquet").select("trace_id", "prompt", "agent_response").distinct().collect():
        defect_ = found.get((r.trace_id, "agent_response"))
        asked, said_ = (word.findall((t or "").lower()) for t in (r.prompt, r.agent_response))
        if not said_:  # nothing but marks, or a picture
            assert (defect_ == "empty") == (not any(c in (r.agent_response or "") for c in "✅👍🙂")), r
        elif asked and len(said_) % len(asked) == 0 and said_ == asked * (len(said_) // len(asked)):
            assert defect_ == "copied", r
        elif defect_ == "copied":  # after a short lead-in
            assert said_[-len(asked) :] == asked and len(said_) % len(asked) <= 6, r
        elif defect_ is None:
            assert said_ and not r.agent_response.rstrip().endswith((",", "-", ":", "…")), r


CUT = [(1, "f", "status", "Half of the"), (2, "f", "status", "Each kettle"), (3, "f", "status", "Steps:\n- load_ideas\n- load"), (4, "f", "status", "All is done"), (5, "f", "status", "Old kettle")]
WHOLE = [(10 + i, "f", "status", t) for i, t in enumerate(("Half of the markets are open.", "Each kettle is full.", "Steps:\n- load_ideas\n- load_ideas", "All is done", "It holds a kettle.") * 4)]


def test_contexts_decide(spark, monkeypatch):
    """Short answers and lists are told apart by how often texts go on there, in a table of any size."""
    schema = "id long, field_name string, prompt string, response string"
    rare = spark.createDataFrame(CUT + WHOLE, schema)
    for more in (0, 50_000):
        others = spark.range(more).selectExpr("id + 1000 as id", "'f' as field_name", "'list items' as prompt", "concat('Word', id, ' was run by item', id, '.') as response")
        assert sorted(r.id for r in broken_pairs(rare.unionByName(others)).collect()) == [1, 2, 3]
    monkeypatch.setattr(module, "LEAST", 1 << 40)
    assert sorted(r.id for r in broken_pairs(rare).collect()) != [1, 2, 3]


def test_contexts_against_counting():
    counts = Contexts()
    for text in ("The step is done. The step", "The step", "- the step\n- a step", "step step!"):
        counts.add(text.lower(), words_of(text))
    got = {k: (n, e) for k, n, e in counts.counts()}
    assert got[ending("step")] == (7, 3) and got[ending("the")] == (4, 0)  # a text that just stops tells nothing
    assert got[begun(["the", "step"])] == (3, 1) and got[begun(["the"])] == (3, 0)


def test_compression_decides(monkeypatch):
    """Copies are told by the bytes that are left, against a comparison of words."""
    rng = random.Random(5)
    words = "a be see list items status show the next step rewind Zelmo état über 日本 x1".split()
    for _ in range(3_000):
        prompt = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        answer = prompt * rng.randint(1, 3)
        for _ in range(rng.choice((0, 1, 1, 2))):
            i, j = rng.randrange(len(answer)), rng.randrange(len(answer))
            answer[i], answer[j] = rng.choice(((rng.choice(words), answer[j]), (answer[j], answer[i]), ("".join(rng.sample(answer[i], len(answer[i]))), answer[j])))
        a, b = " ".join(prompt).lower().split(), " ".join(answer).lower().split()
        assert copied(" ".join(prompt), " ".join(answer)) == (len(b) % len(a) == 0 and b == a * (len(b) // len(a))), (prompt, answer)
    long = " ".join(str(rng.random()) for _ in range(40_000))
    assert copied(long, f"You asked: {long} {long}") and not copied(long, f"{long} {long[:-1]}x")
    assert not copied("list items", "bist items")
    monkeypatch.setattr(module, "spent", lambda asked, text: 0)  # without it any text of the length is one
    module._floor.cache_clear()
    assert copied("list items", "bist items")
    module._floor.cache_clear()


def test_wrapped_refusals():
    assert refused("I am sorry, but I cannot\nhelp with that.") and not refused("The step is done.\nNo items are waiting")
