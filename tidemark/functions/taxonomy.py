"""Canonical labels: value maps, ordered rules, and the lists that decide how a label is rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label maps, rules in the order in which they are tried (None: recognised, but no event), and class lists.
NV_MAP = {
    "sigh": "sigh", "sniff": "sniff", "laughing": "laugh", "coughing": "cough", "throatclearing": "throat_clear",
    "breath": "breath", "crying": "cry", "gasp": "gasp", "yawn": "yawn", "snore": "snore",
}
SLR_MAP = {
    "coughing": "cough", "yawning": "yawn", "throat-clearing": "throat_clear", "sighing": "sigh", "lip-smacking": "lip_smack",
    "lip-popping": "lip_smack", "panting": "breath", "crying": "cry", "laughing": "laugh", "sneezing": "sneeze",
    "nose-blowing": "nose_blow", "moaning": "groan", "screaming": "scream", "tongue-clicking": "click",
    "teeth-chattering": None, "teeth-grinding": None,
}
NOISE = "__noise__"
DNC_MAP = {
    "TV": "tv_speaker", "Radio": "tv_speaker", "Music": "music", "autos": "vehicle", "WashingMachine": "machine",
    "WaterHeater": "machine", "Dishwasher": "machine", "CoffeeMachine": "machine", "VacuumCleaner": "machine",
    "Microwave": "machine", "quiet": NOISE, "people": NOISE,
}
DEMAND_MAP = {"STRAFFIC": "vehicle", "TBUS": "vehicle", "TCAR": "vehicle", "TMETRO": "vehicle", "DWASHING": "machine"}
EMOJI = {"🌬": "breath", "🤣": "laugh", "👃": "sniff", "😷": "cough", "🗣": "throat_clear", "😤": "sigh", "😖": "groan", "🤧": "sneeze", "😴": "snore", "🐖": "groan"}
TAG_RULES = [
    (r"\b(child|children|kids?|baby|human|people)\b.*\b(talking|speaking|voices?)\b|human (noise|sound)", None),
    (r"\b(child|children|kids?|baby)\b.*\bcry", "baby_cry"),
    (r"laugh", "laugh"),
    (r"cough", "cough"),
    (r"throat", "throat_clear"),
    (r"sneez", "sneeze"),
    (r"nose (blow|clear)", "nose_blow"),
    (r"lip.?smack", "lip_smack"),
    (r"breath|inhal|exhal", "breath"),
    (r"sniff|snort", "sniff"),
    (r"yawn|yawing", "yawn"),
    (r"snor", "snore"),
    (r"gasp", "gasp"),
    (r"\b(child|children|kids?|baby)\b", "child_voice"),
    (r"siren|ambulance|alarm", "siren"),
    (r"horn|honk", "horn"),
    (r"bark|\bdog\b", "dog_bark"),
    (r"insect|cricket|\bbugs?\b|beetle", "insect"),
    (r"bird|crow|caw|rooster|\bcock\b|\bhen\b|cluck|duck|cuckoo|sparrow|squawk|twitter|chirp", "bird"),
    (r"\bcow\b|goat|\bcat\b|meow|buffalo|frog|squirrel|animal", "animal"),
    (r"whistl", "whistle"),
    (r"music|song|sing|flute|drum|band sound|prayer|mantra|chant|record playing", "music"),
    (r"\bfan\b", "fan"),
    (r"vibrat", "phone_vibrate"),
    (r"bell|chim", "bell"),
    (r"\bring(ing|tone|s)?\b|ringtone", "phone_ring"),
    (r"beep|notification|message tone|phone sound|mobile sound|phone click", "beep"),
    (r"buzz", "buzzer"),
    (r"\btv\b|television|speaker|\bmic\b|\bmike\b", "tv_speaker"),
    (r"vehicle|traffic|engine|bike|motor|\bcar\b|train|tractor|aeroplane|rickshaw", "vehicle"),
    (r"machine|generator|factory|typing|tick|clock|pump", "machine"),
]
ONTOLOGY_RULES = [
    (r"speech synthesizer|howl \(wind\)|sliding door|sanding|bellow|crowd|growling", None),
    (r"^(baby cry|infant cry)", "baby_cry"),
    (r"baby laughter|^laughter|giggle|snicker|belly laugh|chuckle", "laugh"),
    (r"^crying|sobbing|^whimper$", "cry"),
    (r"^cough", "cough"),
    (r"^sneeze", "sneeze"),
    (r"^sniff", "sniff"),
    (r"^snoring", "snore"),
    (r"^sigh", "sigh"),
    (r"^gasp", "gasp"),
    (r"throat clearing", "throat_clear"),
    (r"^yawn", "yawn"),
    (r"^(groan|grunt)", "groan"),
    (r"^(screaming|shriek|yell)", "scream"),
    (r"^(breathing|pant|wheeze)", "breath"),
    (r"^whispering", "whisper"),
    (r"^shout|battle cry", "shout"),
    (r"^chewing", "chew"),
    (r"^burping", "burp"),
    (r"^hiccup", "hiccup"),
    (r"nose blowing", "nose_blow"),
    (r"lip smack", "lip_smack"),
    (r"^child|^children", "child_voice"),
    (r"siren|emergency vehicle|alarm", "siren"),
    (r"horn|honking|^toot$", "horn"),
    (r"^(bark|dog|yip|bow-wow|howl|bay)", "dog_bark"),
    (r"insect|cricket|mosquito|^fly|bee, wasp|buzzing insect", "insect"),
    (r"bird|chirp|tweet|^crow($|ing)|^caw|squawk|pigeon|^coo$|rooster|chicken|duck|quack|^owl", "bird"),
    (r"cattle|moo|goat|bleat|^cat$|meow|purr|frog|croak|horse|neigh|^pig|oink|sheep|animal", "animal"),
    (r"whistl", "whistle"),
    (r"television|^radio", "tv_speaker"),
    (r"mechanical fan|air conditioning", "fan"),
    (r"vibrating alert", "phone_vibrate"),
    (r"telephone bell|ringtone|^telephone$", "phone_ring"),
    (r"bell\b|^ding|wind chime", "bell"),
    (r"beep|bleep|dtmf", "beep"),
    (r"^buzz", "buzzer"),
    (r"music|singing|song|choir|orchestra|guitar|piano|drum|flute|violin|synthesizer|keyboard \(musical\)|instrument", "music"),
    (r"vacuum cleaner|washing machine|dishwasher|blender|hair dryer|electric shaver|sewing machine|microwave|printer|typing|computer keyboard|clock|tick-tock", "machine"),
    (r"^(clapping|applause)", "applause"),
    (r"^(cheering|whoop)", "cheer"),
    (r"^crowd$|hubbub|speech babble", "crowd"),
    (r"footsteps|^run$", "footsteps"),
    (r"^wind$|^wind noise", "wind"),
    (r"thunder", "thunder"),
    (r"^rain|^patter", "rain"),
    (r"^water|splash|^pour|^drip|trickle|^stream$|^liquid|gurgling|toilet flush|waves|^ocean", "water"),
    (r"^knock", "knock"),
    (r"^door$|^slam", "door"),
    (r"^dishes|cutlery|chink, clink", "dishes"),
    (r"^shatter|^breaking", "glass_break"),
    (r"gunshot|machine gun|cap gun|artillery", "gunshot"),
    (r"explosion|firecracker|fireworks", "explosion"),
    (r"^hammer|power tool|^drill|chainsaw|^sawing|^tools$", "construction"),
    (r"vehicle|^car|truck|^bus$|helicopter|motorboat|subway|air brake|motorcycle|traffic|engine|idling|revving|race car|train|railroad|rail transport|aircraft|tractor", "vehicle"),
]
SPEAKER_EVENTS = [
    "breath", "sigh", "sniff", "laugh", "cough", "throat_clear", "cry", "gasp", "yawn", "snore", "sneeze", "nose_blow",
    "lip_smack", "groan", "scream", "whisper", "shout", "chew", "burp", "hiccup", "click",
]
BACKGROUND_EVENTS = [
    "horn", "vehicle", "siren", "bird", "insect", "dog_bark", "animal", "child_voice", "baby_cry", "music", "tv_speaker",
    "machine", "fan", "phone_ring", "phone_vibrate", "beep", "bell", "whistle", "buzzer", "applause", "cheer", "crowd",
    "footsteps", "wind", "rain", "thunder", "water", "knock", "door", "dishes", "glass_break", "gunshot", "explosion",
    "construction",
]
DROP = "__drop__"
MIN_EVENTS = 80

EVENTS = SPEAKER_EVENTS + BACKGROUND_EVENTS
INLINE = frozenset(SPEAKER_EVENTS)


def mapped(value: Column, table: dict, default: str | None = None) -> Column:
    """The table's value for a label; default for a label that it lacks, null where it holds None."""
    out = F.lit(default)
    for target in dict.fromkeys(table.values()):
        own = [k for k, v in table.items() if v == target]
        out = F.when(value.isin(own), F.lit(target)).otherwise(out)
    return out


def _first_rule(text: Column, rules: list, otherwise: str | None) -> Column:
    out = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def canon_tag(tag: Column) -> Column:
    """A free-text tag's label by the first rule that fits; null for speech, DROP for none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(tag), r"[<>\[\]_]", " "), r"\s+", " "))
    return _first_rule(plain, TAG_RULES, DROP)


def canon_ontology(name: Column) -> Column:
    """An ontology name's label by the first rule that fits; null for false friends and for none."""
    return _first_rule(F.lower(name), ONTOLOGY_RULES, None)


def is_inline(label: Column) -> Column:
    """True for a speaker's own sounds, which stand in a transcript as one tag; others wrap words."""
    return label.isin(sorted(INLINE))


def emoji_tokens(text: Column) -> Column:
    """array<struct<label,k>>: each sound emoji of a transcript and how many words stand before it.

    Words are runs of letters a-z and apostrophes that hold a letter.
    """
    pattern = "|".join(EMOJI) + "|[a-z']*[a-z][a-z']*"
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    marks = mapped
    step = lambda acc, t: F.when(marks(t, EMOJI).isNull(), F.struct((acc["n"] + 1).alias("n"), acc["out"].alias("out"))).otherwise(
        F.struct(acc["n"].alias("n"), F.concat(acc["out"], F.array(F.struct(marks(t, EMOJI).alias("label"), acc["n"].alias("k")))).alias("out")))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<label:string,k:int>>").alias("out"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])
