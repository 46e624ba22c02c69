"""A small labelled URL table: hosts put together from words, with paths that tell nothing.

Words of unwanted hosts are those of gambling, pills, adult pages, spam, piracy and usury; words
of wanted ones are of schools, trades, places and things; a third of the wanted hosts have names
without meaning, as most hosts' names are to a reader. Word lists are general: no corpus
had a part in them. Rows are (host, path, allowed, fold); fold 0 is held out.
"""

from __future__ import annotations

import random

UNWANTED = (
    "casino", "poker", "roulette", "betting", "bets", "jackpot", "slots", "blackjack", "lottery", "gamble",
    "pills", "pharma", "viagra", "cialis", "steroids", "dietpill", "weightloss", "botox",
    "adult", "porn", "xxx", "sexcam", "escort", "hookup", "nude", "fetish", "milf",
    "spam", "bulkmail", "clickfarm", "linkfarm", "adserver", "adclick", "popup", "popunder", "tracker", "banner",
    "warez", "torrent", "crack", "keygen", "serials", "nulled", "pirated",
    "payday", "loans", "fastcash", "getrich", "bitcoin-double", "forex-signal", "replica", "fakewatch", "cheap", "discount-rx", "freebie", "winner", "bonus", "prize", "giveaway",
)
WANTED = (
    "library", "school", "college", "university", "academy", "museum", "gallery", "theatre", "orchestra", "archive", "journal", "review", "gazette", "herald", "tribune", "news", "weather", "science",
    "physics", "biology", "chemistry", "history", "geography", "language", "dictionary", "grammar", "poetry", "novel", "garden", "kitchen", "recipes", "bakery", "market", "farmers", "harbour", "railway",
    "bridge", "river", "mountain", "forest", "island", "village", "town", "council", "county", "parish", "clinic", "hospital", "dentist", "nursing", "pharmacology", "software", "compiler", "database", "network",
    "robotics", "engine", "bicycle", "sailing", "hiking", "chess", "football", "cricket", "tennis", "music", "choir", "piano", "guitar", "film", "radio", "travel", "hotel", "camping", "insurance", "bank", "legal",
    "notary", "architect", "carpenter", "plumber", "electric", "solar", "energy", "water", "recycling", "wildlife", "birds", "horses", "dogs", "aquarium", "planetarium", "observatory", "docs", "wiki", "forum", "blog", "mail", "cloud",
)
_PREFIX, _ENDS, _LANGS = ("", "www.", "m.", "blog.", "shop.", "en."), ("com", "net", "org", "info", "io", "de", "fr", "co.uk"), ("en", "de", "fr", "es", "it", "page", "item", "a")


def _name(rng: random.Random) -> str:
    """A name without meaning: two to four syllables."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "ea", "io", "ou"]) + rng.choice(["", "n", "r", "s", "t", "nd", "ng", "st"]) for _ in range(rng.randint(2, 4)))


def urls(seed: int = 5, each: int = 1500) -> list[tuple[str, str, bool, int]]:
    """each rows of either label."""
    rng, out = random.Random(seed), []
    for allowed in (False, True):
        for k in range(each):
            a, b = (rng.choice(WANTED if allowed else UNWANTED) for _ in range(2))
            if allowed and k % 3 == 0:
                a, b = _name(rng), rng.choice([_name(rng), ""])
            elif not allowed and k % 4 == 0:
                b = rng.choice([_name(rng), rng.choice(WANTED), ""])  # one bad word is enough
            elif k % 5 == 0:
                b = ""
            number = str(rng.randint(1, 9)) if rng.random() < 0.1 else ""
            host = rng.choice(_PREFIX) + a + (rng.choice(["-", ""]) + b if b else "") + number + "." + rng.choice(["", "", "example."]) + rng.choice(_ENDS)
            path = rng.choice(["", "/", f"/{rng.choice(_LANGS)}/{rng.randint(1, 99999)}", f"/{rng.choice(_LANGS)}/{_name(rng)}.html"])
            out.append((host, path, allowed, k % 3))
    return out
