"""The texts that explain a result."""

from firnline.operators import match_texts as txt

SCHEMA = "rider_id int, height_cm double, weight_kg double, boot_size_eu double, board_line_preference string, skill_level string, riding_style string, terrain_priority string, aggressiveness string, stance_type string"


def test_explanation(spark):
    riders = spark.createDataFrame([(1, 178.0, 72.5, 43.5, "men", "advanced", "freeride", "groomers-carving", "aggressive", "duck"), (2, 160.0, 50.0, 38.0, "any", "beginner", "all-mountain", "balanced", "balanced", "unknown")], SCHEMA)
    one, two = [r.lines for r in txt.explanation(riders).orderBy("rider_id").collect()]
    assert len(one) == len(two) == 8 and None not in one + two
    assert one[0] == f"Вес 72.5 кг даёт базовый диапазон 152-156 см. Дальше мы мягко подправили его под рост 178 см, стиль {txt.STYLE_NAMES['freeride']} и ваш агрессивный темп катания."
    assert "154-161 см" in one[1] and one[3].endswith(txt.CARVING_CLEARANCE) and "duck stance" in one[3] and one[2] == txt.EXPLAIN_TERRAIN["groomers-carving"]
    assert one[4].startswith(txt.SHAPE_TEXTS["groomers-carving"][0] + " Базовый ориентир здесь — направленная. ")
    assert not two[3].endswith(txt.CARVING_CLEARANCE) and txt.SHAPE_TEXTS["balanced"][1] in two[4] and "начинающий" in two[7]
    assert two[1].startswith("Итоговый диапазон 141-146 см") and "около 143.5 см" in two[1]
