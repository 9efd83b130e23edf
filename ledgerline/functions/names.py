"""Readable names of colours, sets and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of colour combinations in W U B R G order.
GUILDS = {
    "": "Colorless",
    "W": "Mono-White", "U": "Mono-Blue", "B": "Mono-Black",
    "R": "Mono-Red", "G": "Mono-Green",
    "WU": "Azorius", "WB": "Orzhov", "WR": "Boros", "WG": "Selesnya",
    "UB": "Dimir", "UR": "Izzet", "UG": "Simic",
    "BR": "Rakdos", "BG": "Golgari", "RG": "Gruul",
    "WUB": "Esper", "WUR": "Jeskai", "WUG": "Bant",
    "WBR": "Mardu", "WBG": "Abzan", "WRG": "Naya",
    "UBR": "Grixis", "UBG": "Sultai", "URG": "Temur", "BRG": "Jund",
    "WUBRG": "Five-Color",
}
#: Names of sets.
SETS = {
    "OM1": "Marvel's Spider-Man", "SPM": "Marvel's Spider-Man",
    "EOE": "Edge of Eternities", "FIN": "Final Fantasy",
    "TDM": "Tarkir: Dragonstorm", "DFT": "Aetherdrift",
    "FDN": "Foundations", "DSK": "Duskmourn: House of Horror",
    "BLB": "Bloomburrow", "OTJ": "Outlaws of Thunder Junction",
    "MKM": "Murders at Karlov Manor", "LCI": "The Lost Caverns of Ixalan",
    "WOE": "Wilds of Eldraine", "LTR": "The Lord of the Rings",
    "MOM": "March of the Machine", "MAT": "March of the Machine: The Aftermath",
    "ONE": "Phyrexia: All Will Be One", "BRO": "The Brothers' War",
    "DMU": "Dominaria United", "HBG": "Alchemy Horizons: Baldur's Gate",
    "SNC": "Streets of New Capenna", "NEO": "Kamigawa: Neon Dynasty",
    "VOW": "Crimson Vow", "MID": "Midnight Hunt", "AFR": "Adventures in the Forgotten Realms",
    "STX": "Strixhaven", "KHM": "Kaldheim", "ZNR": "Zendikar Rising",
    "M21": "Core Set 2021", "IKO": "Ikoria", "THB": "Theros Beyond Death",
    "ELD": "Throne of Eldraine", "M20": "Core Set 2020", "WAR": "War of the Spark",
    "RNA": "Ravnica Allegiance", "GRN": "Guilds of Ravnica",
    "Cube": "Cube", "Chaos": "Chaos Draft",
}
#: Words of an event id that name a limited event.
LIMITED = {
    "PremierDraft": "Premier Draft",
    "QuickDraft": "Quick Draft",
    "TradDraft": "Traditional Draft",
    "CompDraft": "Competitive Draft",
    "OpenDraft": "Draft",
    "Draft": "Draft",
    "Sealed": "Sealed",
    "TradSealed": "Traditional Sealed",
    "OpenSealed": "Sealed",
    "CompSealed": "Competitive Sealed",
}
#: Words that name a format, and those that only hint at one or at matches of three.
FORMATS = {
    "Standard": "Standard",
    "Alchemy": "Alchemy",
    "Historic": "Historic",
    "HistoricBrawl": "Historic Brawl",
    "Explorer": "Explorer",
    "Pioneer": "Pioneer",
    "Timeless": "Timeless",
    "Pauper": "Pauper",
    "Brawl": "Brawl",
    "Gladiator": "Gladiator",
    "Singleton": "Singleton",
    "Pandemonium": "Pandemonium",
}
HINTS = ("Ladder", "Play", "Constructed", "Event", "BestOf3", "BestOf1", "Bo3", "Bo1")
OF_THREE = ("Traditional", "BestOf3", "Bo3")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def guild_name(letters: Column) -> Column:
    """The name of a set of colour letters in any order."""
    key = F.concat(*(F.when(F.contains(letters, F.lit(c)), c).otherwise("") for c in "WUBRG"))
    own = F.when(letters.isNull(), "").otherwise(key)
    return F.coalesce(F.try_element_at(_table(GUILDS), own), F.concat(F.length(own), F.lit("-Color")))


def set_name(code: Column) -> Column:
    """The name of a set code, else the code; null for none."""
    names = _table(SETS)
    return F.when(code != "", F.coalesce(F.try_element_at(names, code), F.try_element_at(names, F.upper(code)), code))


def event_name(event: Column, deck_set: Column) -> Column:
    """Limited events by their set (the event's, else the deck's), others by their format; an event id of neither kind in words."""
    words = F.split(event, "_")
    first = lambda kept: F.get(F.filter(words, kept), F.lit(0))
    limited, formats = _table(LIMITED), _table(FORMATS)
    joined = F.array_join(words, "")
    label = F.coalesce(F.try_element_at(limited, first(lambda w: w.isin(*LIMITED))), F.when(joined.contains("Sealed") & ~joined.contains("Draft"), "Sealed").when(joined.contains("Limited"), "Draft"))
    code = first(lambda w: ~w.isin(*LIMITED) & (w.isin(*SETS) | (w.rlike("^[A-Z0-9]{2,5}$") & ~w.rlike("^[0-9]+$"))))
    name = set_name(F.coalesce(code, deck_set))
    plain = F.coalesce(F.try_element_at(formats, first(lambda w: w.isin(*FORMATS))), F.when(F.exists(words, lambda w: w.isin(*HINTS)), "Standard"))
    three = F.when(F.exists(words, lambda w: w.isin(*OF_THREE)), " (Bo3)").otherwise("")
    spaced = F.regexp_replace(F.get(words, F.lit(0)), r"(?<=[^A-Z])(?=[A-Z])", " ")
    built = F.when(plain.isNotNull(), F.concat(plain, three)).otherwise(F.coalesce(F.nullif(F.trim(spaced), F.lit("")), event))
    return F.when(F.coalesce(event, F.lit("")) == "", set_name(deck_set)).when(label.isNotNull(), F.concat_ws(" ", name, label)).otherwise(built)
