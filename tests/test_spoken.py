"""Reading aloud: formulas and texts by hand, and the way back to the source."""

import random
import re

import pytest

from lexweave.operators import mathread, text
from lexweave.operators.spoken import Options, speak

FORMULAS = {
    r"\frac{QK^{T}}{\sqrt{d_k}}": "Q K transpose over square root of d sub k",
    r"f(x) = \sum_{i=1}^{n} w_i x_i + b": "f of x equals the sum from i equals 1 to n of w sub i x sub i plus b",
    r"\hat{y} = \sigma(z)": "y hat equals sigma of z",
    r"\mathcal{L} = -\log P(y \mid x)": "L equals minus log P of y given x",
    r"\mathbf{x} \in \mathbb{R}^{d}": "x in R to the d",
    r"\lambda = 0.01": "lambda equals 0 point 0 1",
    r"\Theta(n \log n)": "big theta of n log n",
    r"\sqrt[3]{x}": "3 root of x",
    "P(y | x)": "P of y given x",
    "O(|V|^2)": "big O of the size of V squared",
    "O((V + E) log V)": "big O of V plus E log V",
    "A^{-1}": "A inverse",
    "α ≤ β": "alpha less than or equal to beta",
    "x²": "x squared",
    r"\frac{a}{b": None, r"\unknown x": None, "(a": None, "a)": None, "": None, "{": None, "^": None, "|x": None, "(" * 3000: None,
}
TEXTS = {
    "Sorting takes O(n log n) time [12].": "Sorting takes big O of n log n time.",
    "Transformers (Vaswani et al., 2017) use attention.": "Transformers use attention.",
    "See Fig. 3b and Eq. (2), e.g., the loss.": "See Figure 3 b and Equation 2, for example, the loss.",
    "See also pp. 10-12 and No. 5.": "See also pages 10 to 12 and number 5.",
    "Dr. Smith & colleagues, etc.": "Doctor Smith and colleagues, etcetera.",
    "It has 175B parameters and 16GB of RAM.": "It has 175 billion parameters and 16 gigabytes of ram.",
    "A learning rate of 1e-4.": "A learning rate of 1 times ten to the minus 4.",
    "Accuracy rose by 3.5%.": "Accuracy rose by 3 point 5 percent.",
    "It is ~3x faster.": "It is approximately 3 times faster.",
    "It cost $5M to train.": "It cost 5 million dollars to train.",
    "An 82M-parameter network.": "An 82 million parameter network.",
    "Our CNN beats LSTMs; NASA uses SLAM.": "Our C N N beats L S T M's; nasa uses slam.",
    "Let x_i be the input and y^2 the output.": "Let x sub i be the input and y squared the output.",
    "See https://github.com/foo/bar now.": "See a link to github dot com now.",
    "Edit train_model.py first.": "Edit train model dot py first.",
    "Call get_batch() with numEpochs.": "Call get batch with num epochs.",
    "Mail team@example.org.": "Mail an email address.",
    "fast — but costly": "fast, but costly",
    "the (ii) second item": "the two, second item",
    r"Bad $\frac{a}{b$ stays.": r"Bad $\frac{a}{b$ stays.",
    "Attention is all you need.": "Attention is all you need.",
    "": "",
}


@pytest.mark.parametrize("source", FORMULAS)
def test_formulas(source):
    assert mathread.read(source) == FORMULAS[source]


@pytest.mark.parametrize("source", TEXTS)
def test_texts(source):
    assert speak(source).text == TEXTS[source]


def test_options():
    assert speak("As in [3, 5–7].", Options(citations="read")).text == "As in citing 3, 5 to 7."
    assert speak(r"Let $x^2$ be.", Options(math="skip")).text == "Let a formula be."
    assert speak("At https://x.org now.", Options(urls="link")).text == "At a link now." and speak("At https://x.org now.", Options(urls="skip")).text == "At now."
    assert speak("NASA and SLAM", Options(acronyms="spell")).text == "N ay S ay and S L ay M"
    assert speak("LaTeX on Kubernetes", Options(lexicon={"LaTeX": "lay tek", "Kubernetes": "k eight s"})).text == "lay tek on k eight s"
    assert speak("3.2 Related Work", Options(heading=True)).text == "Section 3 point 2. Related Work." and speak("Abstract", Options(heading=True)).text == "Abstract."
    assert speak(None).text == ""


def check_back(source):
    spoken = speak(source)
    assert len(spoken.at) == len(spoken.text)
    assert all(0 <= a < b <= len(source) for a, b in spoken.at) and all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(spoken.at, spoken.at[1:], strict=False))
    for m in re.finditer(r"\w+", spoken.text):
        a, b = spoken.source(*m.span())
        assert source[a:b].strip()
        if len({*spoken.at[m.start() : m.end()]}) == b - a == len(m[0]):  # as it stands
            assert source[a:b] == m[0]


def test_the_way_back():
    source = "It takes O(n log n) time."
    spoken = speak(source)
    at = spoken.text.index("log")
    assert spoken.source(at, at + 3) == (9, 19) and spoken.source(0, 2) == (0, 2) and spoken.source(2, 3) is None
    r = random.Random(11)
    parts = [*TEXTS, "$x$", "[1]", "3.14", "10-12", "A", "e.g.", "“q”", "(", ")", "\n", "é", "x_1", "5GB", "…", "$", "`a_b`", "GPT-4"]
    for _ in range(1500):
        check_back("".join(r.choice(parts) + r.choice(["", " ", "  "]) for _ in range(r.randint(0, 8))))


def test_spoken_texts_of_a_table(spark):
    from lexweave.plans import all_queries

    assert "q_spoken_text" in all_queries()
    df = spark.createDataFrame([(1, "16GB"), (2, None)], "conv_id long, text string")
    got = {r.conv_id: r.out for r in text.per_row(df, ["text"], lambda t: speak(t).text, "string", "conv_id").collect()}
    assert got == {1: "16 gigabytes", 2: ""}
