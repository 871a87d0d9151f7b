"""Lexicons of action and judgment. Matching stems both the words and the text (see text.stem_hit)."""

from __future__ import annotations

# Words of physical action.
PHYSICAL = """
hit slap punch knock clock fight press crash smash shove push throw
run ran running over jumped jumping tackle choke beat knockout ko
pepperspray spray tase arrest cuff swat swatted pullup pulled pulledup
walkoff walked storm leave left kicked bounce
drive driving follow following stuck lost cooked totaled wreck
cut buzz shave hairline mog looksmax
""".split()
# Words of arguments and callouts.
VERBAL = """
crash crashout crashing yell scream screaming go goingoff
callout called expose exposed deny denied confess confesses admits
admit accuse accusing pressed arguing argument defensive
taunt taunting roast roasted glaze glazing flex flexing
apologize apology sorry
""".split()
# Words of reveals.
REVEALS = """
reveal reveals show showed showing admit admits confess
happen happened actually turnsout foundout realize realized
speechless shook shaken devastated embarrassed shocked surprised
caught catching leak leaked ghost ghosted
""".split()
# Words of reactions.
REACTIONS = "speechless shook devastated embarrassed crying laughing screaming panics panicked cooked dead silent quiet".split()
# Words of family and relationship scenes.
DRAMA = """
cheat cheating cheated jump jumped setup setting
baby dna fridge shower hospital
knife herpes smoke cigarette
pray praying tantrum overstimulated
""".split()
# Words of money and standing.
STATUS = "flex broke negative bank scam scammed sub goal facecard cutline".split()
# Further verbs, and base forms whose inflections double a consonant.
FURTHER = "lost stuck hit ran screaming pressing crashing slapped pulled ghosted cooked following jumping fighting walking walked".split()
BASE_FORMS = "slap clap grab stop drop rob shop hug beg".split()
ACTION = [*PHYSICAL, *VERBAL, *REVEALS, *REACTIONS, *DRAMA, *STATUS, *FURTHER, *BASE_FORMS]
# Words of ego, money, hypocrisy, entitlement and controversy.
JUDGMENT = """
rich broke money cash bag millionaire billionaire mansion car cars
watch jewelry chain flex flexing brag bragging bragged
best goat greatest better untouchable unbeatable nobody king
arrogant ego cocky humble humility delusional delusion clueless
stupid idiot dumb ridiculous obviously wrong
hypocrite hypocrisy contradicts contradiction double standard
entitled deserve deserves rules apply respect disrespect disrespectful
cringe embarrassing awkward desperate trying
rejected rejection ghosted breakup cheat cheated betrayed betrayal
gamble gambling bet betting odds parlay casino slots
racist sexist bigot politics political immigration policing religion
""".split()
# Phrases that are nearly always a moment, on normalised text.
PHRASES = (
    r"\b(i'?m cooked|we'?re cooked|i'?m dead)\b",
    r"\b(no keys|lost the key|car is stuck)\b",
    r"\b(clip it|that'?s a clip)\b",
    r"\b(walked off|walking off)\b",
    r"\b(showed up with a knife)\b",
    r"\b(i tried not to cheat)\b",
    r"\b(real life gta|we'?re actually in gta)\b",
    r"\b(on the (bonnet|hood))\b",
    r"\b(no eye contact)\b",
)
