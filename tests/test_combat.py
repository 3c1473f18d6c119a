import pytest
from pyspark.sql import functions as F

from tidewell.operators import combat as C
from tidewell.operators import drift as D
from tidewell.plans.blocked import seq_block
from tidewell.sources import combat_log as L
from tidewell.sources import reports as RP

WHO = 'Player-1,"Rogue",0x511,0x0,Creature-1,"Boss, Big",0xa48,0x0'
AURA = 'Player-1,"Rogue",0x511,0x0,Player-1,"Rogue",0x511,0x0'
LOG = f"""1/15 20:30:45.000  ENCOUNTER_START,652,"Some Boss",3,10
junk line
1/15 20:30:46.000  SPELL_DAMAGE,{WHO},1752,"Strike",0x1,unit,0x0,1234,0,1
1/15 20:30:46.500  SPELL_AURA_APPLIED,{AURA},6774,"Slice",0x1,BUFF
1/15 20:30:47.000  SWING_DAMAGE,{WHO},unit,0x0,500,0,1
1/15 20:30:48.000  SPELL_CAST_SUCCESS,{WHO},1752,"Strike",0x1
1/15 20:30:56.500  SPELL_AURA_REMOVED,{AURA},6774,"Slice",0x1,BUFF
1/15 20:31:45.000  ENCOUNTER_END,652,"Some Boss",3,10,1
"""


def run(spark, text, who="Rogue", compat=False, width=2):
    lines = spark.createDataFrame([("log", i, s) for i, s in enumerate(text.split("\n"))], "log_id string, seq bigint, line string")
    ev = L.for_character(L.parse_lines(lines, compat=compat), who)
    marked = C.with_markers(ev, seq_block("seq", width))
    inside = C.inside_encounters(marked)
    totals = C.encounter_totals(C.completed_encounters(marked), inside).orderBy("enc_seq").collect()
    abilities = {(r.enc_seq, r.ability): (r.damage, r.casts, round(r.damage_pct, 4)) for r in C.ability_breakdown(inside).collect()}
    uptime = {(r.enc_seq, r.ability): r.uptime for r in C.aura_uptime(C.aura_intervals(inside, seq_block("seq", width))).collect()}
    return totals, abilities, uptime


def test_golden_log(spark):
    totals, abilities, uptime = run(spark, LOG)
    assert len(totals) == 1
    assert (totals[0].enc_id, totals[0].enc_name, totals[0].duration_ms, totals[0].total_damage) == (652, "Some Boss", 60000, 1734)
    assert totals[0].dps == pytest.approx(28.9)
    assert abilities == {(0, "sinister_strike"): (1234, 1, round(1234 / 17.34, 4)), (0, "melee"): (500, 0, round(500 / 17.34, 4))}
    assert uptime == {(0, "slice_and_dice"): pytest.approx(10 / 60)}


def test_other_character_still_has_the_fight(spark):
    totals, abilities, uptime = run(spark, LOG, who="Nobody")
    assert [(t.total_damage, t.dps) for t in totals] == [(0, 0.0)] and not abilities and not uptime


def test_two_fights_and_broken_markers(spark):
    start, end = '1/15 20:00:00.000  ENCOUNTER_START,1,"A"', '1/15 20:00:10.000  ENCOUNTER_END,1,"A"'
    hit = f'1/15 20:00:01.000  SPELL_DAMAGE,{WHO},99999,"x",0x1,u,0x0,10,0,1'
    assert len(run(spark, LOG + LOG)[0]) == 2
    totals, abilities, _ = run(spark, "\n".join([end, hit, start, hit, start, hit, hit, end, hit, start, hit]))
    assert [t.total_damage for t in totals] == [20] and list(abilities) == [(4, "unknown_99999")]


def test_aura_rules(spark):
    on = lambda s, a=7: f'1/15 20:00:{s}.000  SPELL_AURA_APPLIED,{AURA},{a},"x",0x1,BUFF'
    off = lambda s, a=7: f'1/15 20:00:{s}.000  SPELL_AURA_REMOVED,{AURA},{a},"x",0x1,BUFF'
    log = ['1/15 20:00:00.000  ENCOUNTER_START,1,"A"', off("01"), on("02"), on("05"), off("07"), off("08"), on("09", 8), '1/15 20:00:10.000  ENCOUNTER_END,1,"A"']
    uptime = run(spark, "\n".join(log))[2]
    assert uptime == {(0, "buff_7"): pytest.approx(0.2), (0, "buff_8"): pytest.approx(0.1)}


def test_midnight(spark):
    log = ['1/15 23:59:50.000  ENCOUNTER_START,1,"A"', f'1/15 23:59:55.000  SPELL_DAMAGE,{WHO},1752,"x",0x1,u,0x0,100,0,1', '1/16 00:00:10.000  ENCOUNTER_END,1,"A"']
    assert run(spark, "\n".join(log))[0][0].dps == pytest.approx(5.0)
    assert run(spark, "\n".join(log), compat=True)[0][0].dps == 0.0


def test_log_files_keep_line_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LOG * 3)
    (tmp_path / "b.txt").write_text(LOG)
    ev = L.for_character(L.parse_lines(L.read_logs(spark, str(tmp_path))), "Rogue")
    marked = C.with_markers(ev, L.file_block())
    got = C.encounter_totals(C.completed_encounters(marked), C.inside_encounters(marked)).groupBy("log_id").count().orderBy("log_id").collect()
    assert [r["count"] for r in got] == [3, 1]


def test_fight_reasons(spark):
    rows = [(1, False, 60000, 652, 60000), (2, True, 10000, 652, 10000), (3, True, 60000, 999, 60000), (4, True, 60000, 652, 30000),
            (5, True, 60000, 652, 59000), (6, True, 60000, 652, None), (7, True, 60000, 652, 0)]
    f = spark.createDataFrame(rows, "fight_id int, kill boolean, duration_ms long, encounter_id int, active_time_ms long").withColumn("total_damage", F.lit(1000))
    got = {r.fight_id: r.exclusion_reason for r in C.annotate_fights(f).collect()}
    assert got == {1: "wipe", 2: "short_fight", 3: "movement_boss", 4: "death", 5: None, 6: None, 7: None}
    assert {r.fight_id: r.exclusion_reason for r in C.annotate_fights(f, whitelist=[999]).collect()}[5] == "not_in_whitelist"


def test_ability_totals(spark):
    df = spark.createDataFrame([(1, 1752, 10000), (1, 11294, 5000), (1, 26865, 8000), (1, 99999, 1)], "f int, guid int, total long")
    got = {r.ability: r.total for r in C.ability_totals(df, ["f"], "guid", "total").collect()}
    assert got == {"sinister_strike": 15000, "eviscerate": 8000}
    assert [r.guid for r in C.unmapped(df, "guid").collect()] == [99999]


def test_unbuffed_stats(spark):
    row = spark.createDataFrame([(200, 800, 300, 142, 300, 120, 60, [25898, 25898, 5], None, 61999)],
        "strength int, agility int, stamina int, hit_rating int, crit_rating int, haste_rating int, expertise_rating int, auras array<int>, spec_id int, duration_ms long")
    got = C.unbuffed_stats(row, {"kings": {}}).first()
    assert got.buffs == ["kings"] and got.spec == "combat_swords" and got.talents == "20/41/0" and got.fight_length == 61
    assert got.gear_agility == pytest.approx(800 / 1.1 - 180) and got.gear_strength == pytest.approx(200 / 1.1 - 110)
    assert got.gear_stamina == pytest.approx(300 / 1.1 - 100) and got.gear_hit_rating == 142.0


def test_buff_stacking(spark):
    rows = [("c", "flask", "flask", {"attack_power": 120.0}, 0), ("c", "elixir", "battle_elixir", {"agility": 35.0}, 1),
            ("c", "shout1", "shout", {"attack_power": 100.0}, 2), ("c", "shout2", "shout", {"attack_power": 100.0}, 3),
            ("c", "free1", "uncategorized", {"agility_pct": 0.1}, 4), ("c", "free2", "uncategorized", {"boss_armor_reduction": 520.0}, 5),
            ("d", "elixir", "battle_elixir", {"agility": 35.0}, 0)]
    df = spark.createDataFrame(rows, "config string, buff_id string, category string, stats map<string,double>, seq int")
    kept = D.resolve_buffs(df, "config")
    assert {(r.config, r.buff_id) for r in kept.collect()} == {("c", "flask"), ("c", "shout1"), ("c", "free1"), ("c", "free2"), ("d", "elixir")}
    eff = {(r.config, r.stat): (r.total, r.effect) for r in D.buff_effects(kept, "config").collect()}
    assert eff == {("c", "attack_power"): (220.0, "flat"), ("c", "agility_pct"): (0.1, "multiplier"),
                   ("c", "boss_armor_reduction"): (520.0, "armor"), ("d", "agility"): (35.0, "flat")}


def test_trial_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 5.0)], "k string, v double")
    got = {r.k: (r["mean"], round(r.std, 6), r.median, r.min, r.max) for r in D.trial_statistics(df, ["k"], "v").collect()}
    assert got["a"] == (4.0, round(13 ** 0.5, 6), 3.0, 1.0, 8.0) and got["b"] == (5.0, 0.0, 5.0, 5.0, 5.0)


def test_report_json(spark, tmp_path):
    import json
    rep = {"code": "abc", "title": "Raid", "zone": {"id": 5, "name": "Kara"},
           "fights": [{"id": 1, "encounterID": 0, "startTime": 0, "endTime": 50}, {"id": 2, "encounterID": 652, "name": "Boss", "kill": True, "startTime": 1000, "endTime": 61000}],
           "actors": [{"id": 3, "name": "Alice"}, {"id": 4, "name": ""}],
           "combatants": [{"sourceID": 3, "agility": 800, "gear": [{"id": 1, "slot": 15}]}, {"fight": 2, "sourceID": 4}],
           "damage": [{"fight": 2, "entries": [{"name": "Alice", "total": 15000, "activeTime": 58000, "abilities": [{"guid": 1752, "total": 10000}]}]}],
           "buffs": [{"fight": 2, "auras": [{"name": "Kings", "guid": 25898, "totalUptime": 60000, "totalUses": 1}]}],
           "casts": [{"fight": 2, "entries": [{"name": "Alice", "abilities": [{"name": "Strike", "total": 30}, {"name": "Slice"}]}]}],
           "rankings": [{"fightID": 2, "encounterID": 652, "roles": {"dps": {"characters": [{"name": "Alice", "server": {"name": "North"}, "amount": 900.5},
                                                                                      {"name": "Other", "server": "South"}]}, "tanks": {"characters": []}}}]}
    (tmp_path / "r.json").write_text(json.dumps(rep) + "\n" + json.dumps({"code": "old", "archived": True, "fights": rep["fights"]}) + "\n")
    r = RP.read_reports(spark, str(tmp_path))
    head = {x.report_code: x for x in RP.report_rows(r).collect()}
    assert (head["abc"].start_time, head["abc"].end_time, head["abc"].zone_name, head["old"].is_archived) == (1000, 61000, "Kara", True)
    assert [(x.fight_id, x.duration_ms, x.kill) for x in RP.fight_rows(r).collect()] == [(2, 60000, True)]
    assert [(x.fight_id, x.player_name, len(x.gear)) for x in RP.combatant_rows(r).orderBy("source_id").collect()] == [(2, "Alice", 1), (2, "", 0)]
    assert [(x.player_name, x.total_damage) for x in RP.damage_rows(r).collect()] == [("Alice", 15000)]
    assert [(x.buff_guid, x.total_uses) for x in RP.buff_rows(r).collect()] == [(25898, 1)]
    assert sorted((x.ability_name, x.cast_count) for x in RP.cast_rows(r).collect()) == [("Slice", 0), ("Strike", 30)]
    assert sorted((x.player_name, x.server_name, x.dps) for x in RP.fight_ranking_rows(r).collect()) == [("Alice", "North", 900.5), ("Other", "South", 0.0)]


def test_gear_changes_do_not_mix_players(spark):
    rows = [("a", 1, "[1]", "r1"), ("b", 2, "[9]", "r1"), ("a", 3, None, "r2"), ("a", 4, "[]", "r3"), ("b", 5, "[9]", "r3")]
    df = spark.createDataFrame(rows, "player string, seq bigint, gear string, report string")
    got = C.snapshot_changes(df, ["player"], ["seq"], seq_block("seq", 2), "gear", "report").collect()
    assert [(r.player, r.from_report, r.to_report, r.old_value, r.new_value) for r in got] == [("a", "r1", "r2", "[1]", "[]")]
