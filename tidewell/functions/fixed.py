"""Tables, thresholds and patterns that results depend on.

All tables are small (well below 100 rows), so they become literal maps in the
plan and need neither a join nor a broadcast.
"""

# --- fixed values: entity and relation types ---------------------------------
ENTITY_TYPES = [
    "item", "spell", "talent", "talent_tree", "spec", "boss", "instance", "phase", "stat",
    "consumable", "enchant", "gem", "profession", "buff", "debuff", "mechanic", "slot",
]
RELATION_TYPES = [
    "drops_from", "available_in", "equips_in", "has_stat", "crafted_by", "best_in_slot",
    "belongs_to", "spec_uses", "benefits_from", "synergizes_with",
    "affected_by", "threshold_at", "counters", "applies",
    "contains", "has_mechanic", "requires",
]

# --- fixed values: short name -> canonical name ------------------------------
ALIASES = {
    "dst": "dragonspine trophy",
    "wg": "warglaive of azzinoth",
    "t4": "tier 4",
    "t5": "tier 5",
    "t6": "tier 6",
    "snd": "slice and dice",
    "ss": "sinister strike",
    "ar": "adrenaline rush",
    "bf": "blade flurry",
    "ks": "killing spree",
    "evis": "eviscerate",
    "mut": "mutilate",
    "hemo": "hemorrhage",
    "ea": "expose armor",
    "rupture": "rupture",
    "cqc": "close quarters combat",
    "cp": "combat potency",
    "bt": "black temple",
    "ssc": "serpentshrine cavern",
    "tk": "tempest keep",
    "kara": "karazhan",
    "gruuls": "gruul's lair",
    "mh": "mount hyjal",
    "za": "zul'aman",
    "mag": "magtheridon's lair",
    "sp": "shadow labyrinth",
    "ap": "attack power",
    "agi": "agility",
    "str": "strength",
    "sta": "stamina",
    "crit": "critical strike rating",
    "hit": "hit rating",
    "exp": "expertise rating",
    "haste": "haste rating",
    "arp": "armor penetration rating",
    "combat swords": "combat swords",
    "combat daggers": "combat daggers",
    "combat fists": "combat fists",
    "thistle tea": "thistle tea",
}

# --- fixed values: trust -----------------------------------------------------
SOURCE_TRUST = {
    "game_data": 1.0,
    "simulation": 0.9,
    "combat_logs": 0.85,
    "guide": 0.75,
    "expert_guide": 0.75,
    "web": 0.5,
    "archived_theory": 0.7,
    "community": 0.5,
    "unknown": 0.3,
}
DEFAULT_TRUST = 0.3
TRUST_DELTAS = {
    "contradiction": -0.1,
    "correction": -0.15,
    "dead_url": -0.6,
    "confirmation": 0.05,
    "corroboration": 0.05,
}
TRUST_FLOOR, TRUST_CEILING = 0.1, 1.0

# --- fixed values: hours between checks of a site ----------------------------
CHECK_INTERVALS = {
    "wowhead.com": 720,
    "icy-veins.com": 720,
    "shadowpanther.net": 2160,
    "silentshadows.net": 2160,
    "tbcdb.com": 2160,
    "warcraftlogs.com": 24,
}
DEFAULT_CHECK_INTERVAL = 168

# --- fixed values: spell id -> ability, buff id -> buff ----------------------
SPELL_ABILITY = {
    1752: "sinister_strike", 11294: "sinister_strike", 26862: "sinister_strike",
    53: "backstab", 26863: "backstab",
    34413: "mutilate",
    16511: "hemorrhage",
    5938: "shiv",
    26865: "eviscerate",
    26867: "rupture",
    6774: "slice_and_dice",
    32645: "envenom",
    8647: "expose_armor",
    11297: "ambush", 27441: "ambush",
    11290: "garrote", 26884: "garrote",
    1833: "cheap_shot",
    13877: "blade_flurry",
    13750: "adrenaline_rush",
    14177: "cold_blood",
    9512: "thistle_tea",
    14185: "premeditation",
    26891: "instant_poison",
    27282: "deadly_poison",
    27283: "wound_poison",
    23577: "combat_potency",
    13964: "sword_specialization",
    1: "melee",
}
BUFF_NAME = {
    25898: "kings",
    2048: "battle_shout",
    25359: "grace_of_air",
    25528: "strength_of_earth",
    26990: "motw",
    34300: "lotp",
    16293: "wf_totem",
    27066: "trueshot_aura",
    32182: "heroism",
    35476: "drums_of_battle",
    25225: "sunder_armor",
    26993: "faerie_fire",
    27226: "curse_of_recklessness",
}
# Display names that differ from plain title case.
DISPLAY_NAME = {"slice_and_dice": "Slice and Dice"}

# --- fixed values: encounters without forced movement ------------------------
STATIONARY_ENCOUNTERS = [
    200663, 200664, 200670, 652, 649, 623, 624, 730, 601, 602, 725, 726,
]

# --- fixed values: drift thresholds in percent (pass, warn) ------------------
RATE_THRESHOLDS = (5.0, 10.0)
ABILITY_THRESHOLDS = (15.0, 30.0)
UPTIME_THRESHOLDS = (5.0, 10.0)

# --- fixed values: quality gate ----------------------------------------------
GATE = {"faithfulness": 0.8, "relevancy": 0.7, "trajectory": 0.7, "accuracy": 0.7}

# --- fixed values: retrieval -------------------------------------------------
RRF_K = 60
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
TOP_K, FETCH_K, FETCH_MULTIPLIER = 5, 20, 3
GRAPH_TOP_K = 20

# --- fixed values: chunking, in tokens of four characters --------------------
CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP = 400, 50, 50

# --- fixed values: how a rate is written in an answer, most specific first ----
RATE_PATTERNS = [
    r"(?i)\"?mean[_\s]?dps\"?\s*[:=]\s*(\d+(?:\.\d+)?)",
    r"(?i)(?:mean|average|avg)\s+DPS[:\s]+(\d+(?:\.\d+)?)",
    r"(?i)DPS[:\s]+(\d+(?:\.\d+)?)",
    r"(?i)(\d+(?:\.\d+)?)\s+(?:mean\s+)?DPS\b",
]
CLIP_MARKER = "\n\n[... truncated ...]\n\n"

# --- fixed values: slots of character exports, by the names and numbers of the three formats
KEY_VALUE_SLOTS = {
    "head": "head", "neck": "neck", "shoulder": "shoulder", "back": "back", "chest": "chest", "wrist": "wrist", "hands": "hands",
    "waist": "waist", "legs": "legs", "feet": "feet", "finger1": "ring_1", "finger2": "ring_2", "trinket1": "trinket_1",
    "trinket2": "trinket_2", "main_hand": "main_hand", "off_hand": "off_hand", "ranged": "ranged",
}
TITLED_SLOTS = {
    "Head": "head", "Neck": "neck", "Shoulder": "shoulder", "Back": "back", "Chest": "chest", "Wrist": "wrist", "Hands": "hands",
    "Waist": "waist", "Legs": "legs", "Feet": "feet", "Ring 1": "ring_1", "Ring 2": "ring_2", "Finger 1": "ring_1", "Finger 2": "ring_2",
    "Trinket 1": "trinket_1", "Trinket 2": "trinket_2", "Main Hand": "main_hand", "Off Hand": "off_hand", "Ranged": "ranged",
}
NUMBERED_SLOTS = {
    0: "head", 1: "neck", 2: "shoulder", 3: "back", 4: "chest", 5: "wrist", 6: "hands", 7: "waist", 8: "legs", 9: "feet",
    10: "ring_1", 11: "ring_2", 12: "trinket_1", 13: "trinket_2", 14: "main_hand", 15: "off_hand", 16: "ranged",
}

# --- fixed values: build and talents by numeric spec id
SPEC_BUILDS = {
    259: ("assassination_mutilate", "41/20/0"),
    260: ("combat_swords", "20/41/0"),
    261: ("combat_swords", "20/41/0"),
}
