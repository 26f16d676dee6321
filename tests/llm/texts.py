"""Short texts in four languages."""

import random

WORDS = {
    "en": "the quick river runs over stones and under bridges while old trees watch every season change their color",
    "de": "der schnelle fluss fließt über steine und unter brücken während alte bäume jede jahreszeit beobachten",
    "fr": "la rivière rapide coule sur les pierres et sous les ponts pendant que les arbres anciens regardent",
    "es": "el río rápido corre sobre las piedras y bajo los puentes mientras los árboles viejos observan cada estación",
}


def sentences(lang: str, n: int, seed: int = 0) -> str:
    rng = random.Random(f"{lang}{n}{seed}")
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
