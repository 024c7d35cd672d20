"""Declared schemas of envelopes and their payloads; nothing is inferred at read time."""

ENVELOPE = "v int, seq bigint, ts string, type string, server_session string, round string, player string, game_ms double, data string, _corrupt string"

_ENTITY = "kind:string,object_id:string,instance_id:string,name:string,x:double,y:double,vx:double,vy:double,is_missile:boolean,game_ms:double"
_HIT = "victim_session_id:string,damage:double,hit_damage:double,is_player:boolean,type:string,object_id:string,x:double,y:double,hit_x:double,hit_y:double,distance:double"

#: Fields of ``data`` that typed tables need, over all event types.
DATA = (
    "identity string, account_name string, character_name string, is_bot boolean, team string, reason string, ping int, message string, profile string, map string, "
    "duration_ms double, winners array<string>, draw boolean, result_source string, composition array<struct<session_id:string,team:string>>, "
    "attacker_session_id string, victim_session_id string, damage double, damage_type string, weapon string, distance double, is_player boolean, action string, "
    f"hits array<struct<{_HIT}>>, entities array<struct<{_ENTITY}>>, objects array<struct<{_ENTITY}>>, object struct<{_ENTITY}>, projectile struct<{_ENTITY}>, "
    "object_id string, hit_object_id string, source_id string, source_is_player boolean, source_player_session_id string, field_map string, records array<string>, "
    "x double, y double, vx double, vy double, hit_x double, hit_y double, game_ms double, trigger string, coverage double, name string, samples array<struct<x:double,y:double,game_ms:double>>, "
    "stats map<string,double>, checkpoint string, hz double"
)
