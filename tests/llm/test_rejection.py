from textmill.llm import language_id

from .test_models import SYLLABLES, speak


def test_an_unlearned_language_is_rejected():
    texts, labels = zip(*[(speak(lang, i, 20 + i % 40).encode(), lang) for i, lang in enumerate(list(SYLLABLES) * 80)])
    model = language_id.train(list(texts), list(labels))
    known = model.probabilities([speak(lang, 5000 + i, 40).encode() for i, lang in enumerate(list(SYLLABLES) * 10)]).max(axis=1)
    other = model.probabilities([" ".join(["это", "совсем", "другой", "язык", "без", "меток"][i % 5 :] * 8).encode() for i in range(10)]).max(axis=1)
    assert (known >= model.threshold).mean() > 0.95 and (other < model.threshold).all()
