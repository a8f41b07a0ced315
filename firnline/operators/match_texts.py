"""What a rider is told about a recommendation: reasons, comparison, impact of the priority, explanation.

All of it is column expressions over ``recommend.candidates`` and ``recommend.with_profile``; the texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.catalogue import number_text, size_label
from firnline.operators.recommend import choose, recommend, skill_points, style_points, terrain_points, with_profile

# The texts shown -----------------------------------------------------------------------------------
SHAPES = {"twin": "твин", "asym-twin": "асимметричный твин", "directional-twin": "направленный твин", "directional": "направленная", "tapered-directional": "направленная с тейпером"}
TERRAINS = {"balanced": "один универсальный вариант", "switch-freestyle": "свич, парк и side hits", "groomers-carving": "трасса и дуги", "soft-snow": "мягкий снег и разбитка"}
STYLES = {"all-mountain": "универсальное катание", "park": "фристайл и парк", "freeride": "трасса и мягкий снег"}
FITS = {"best-overall": "лучший общий", "playful": "более игривый", "stable": "более стабильный", "width-safe": "запас по ширине"}
CONFIDENCES = {"high": "Высокая уверенность в совпадении.", "medium": "Хорошее совпадение по ключевым параметрам.", "careful": "Пограничный вариант, который стоит перепроверить."}
ROLES = {"best-overall": "лучший общий вариант", "playful": "более живой вариант", "stable": "более стабильный вариант", "width-safe": "больше запаса по ширине"}
SUMMARIES = {
    "best-overall": "Самый ровный и универсальный вариант без явного перекоса в одну сторону.",
    "playful": "Лучше подойдёт, если хочется манёвреннее и живее ощущение доски.",
    "stable": "Лучше подойдёт, если важнее стабильность на скорости и уверенность в дуге.",
    "width-safe": "Лучше подойдёт, если хочется максимального запаса под ботинок и спокойствия по ширине.",
}
REASONS = {
    "compromise": "Размер уже не выглядит цельным вариантом: компромисс заметен сразу по нескольким базовым параметрам.",
    "length-ideal": "Размер попадает не просто в диапазон, а близко к идеальной длине под ваш сценарий.",
    "length-lively": "Размер остаётся внутри диапазона и даёт чуть более живое, манёвренное ощущение.",
    "length-stable": "Размер остаётся внутри диапазона и даёт чуть больше запаса по стабильности.",
    "length-near": "Размер рядом с целевым диапазоном и может подойти, если вам нужен небольшой сдвиг по ощущениям.",
    "weight": "Вес попадает в рабочий диапазон именно этого размера, поэтому доска не должна ощущаться случайной.",
    "style": "Характер доски совпадает с вашим стилем катания.",
    "shape-first": "Форма %s лучше всего совпадает с вашим сценарием.",
    "shape-other": "Форма %s остаётся хорошим вариантом под ваш стиль катания.",
    "skill": "Уровень доски не выбивается из вашего текущего уровня катания.",
    "flex": "Жёсткость доски ближе к тому диапазону, который логичен под ваш темп и сценарий катания.",
    "flex-soft": "Жесткость модели выглядит слишком мягкой под ваш темп и сценарий катания.",
    "flex-too-soft": "Для вашего сценария эта доска выглядит слишком мягкой по жесткости.",
    "flex-stiff": "Жесткость модели уже уходит в слишком дубовую сторону под ваш сценарий.",
    "flex-too-stiff": "Для вашего сценария эта доска выглядит слишком жесткой.",
    "terrain": "Модель хорошо совпадает с вашим главным приоритетом катания.",
    "camber": "Прогиб доски хорошо совпадает с тем, как вы собираетесь кататься и какого ощущения ждёте от доски.",
    "width": "Ширины хватает под ботинок без лишнего ухода в слишком широкую платформу.",
    "width-over": "Ширина безопасная, но эта доска уже чуть шире оптимума под ваш сценарий.",
    "width-edge": "Ширина уже близка к границе под ваш ботинок, поэтому запас получается сомнительным.",
    "width-risk": "Ширина может быть пограничной для вашего ботинка и требует осторожности.",
}
HIGHLIGHTS = {
    "length-low": "По длине это ближе к нижней границе диапазона: доска будет живее в перекантовке.",
    "length-high": "По длине это ближе к верхней границе диапазона: больше стабильности и запаса на скорости.",
    "length-middle": "По длине это центральный вариант: наиболее нейтральный баланс между манёвренностью и стабильностью.",
    "width-much": "Талия %s мм даёт заметный запас относительно целевой ширины %s мм.",
    "width-some": "Талия %s мм даёт небольшой запас относительно целевой ширины %s мм.",
    "width-exact": "Талия %s мм почти точно попадает в целевую ширину %s мм.",
    "width-narrow": "Талия %s мм чуть уже целевой ширины %s мм, поэтому вариант ближе к границе.",
    "style-same": "По характеру доска хорошо совпадает с вашим сценарием: %s.",
    "style-universal": "По характеру это более универсальный вариант без узкой специализации.",
    "style-shifted": 'По характеру доска чуть сильнее смещена в сценарий "%s".',
    "style-compromise": 'По характеру это компромиссный вариант между вашим сценарием и акцентом на "%s".',
    "shape-unknown": "Форма доски у этой карточки пока не уточнена, поэтому здесь меньше прозрачности именно по шейпу.",
    "shape-first": "По форме это точное попадание: %s — базовый ориентир для вашего сценария.",
    "shape-other": "По форме это рабочий компромисс: %s остаётся в хорошей зоне для вашего сценария.",
    "shape-off": 'По форме доска смещена в сторону "%s", поэтому здесь больше компромисса относительно приоритетного сценария.',
    "ready": "Карточка проверена: характеристики сверены с источником, и ссылка на модель живая.",
    "not-ready": "Карточка полезна как ориентир, но её ещё стоит вручную перепроверить перед жёстким выбором.",
}
IMPACT_HEADLINES = {
    "balanced": "Выбран универсальный приоритет, поэтому сервис оставил подбор без лишнего смещения в крайние сценарии.",
    "switch-freestyle": "Приоритет на свич и более живое катание удержал подбор ближе к маневренной стороне.",
    "groomers-carving": "Приоритет на трассу и дуги слегка собрал подбор в сторону стабильности и направленности.",
    "soft-snow": "Приоритет на мягкий снег добавил запас по длине и усилил формы, которые спокойнее работают вне трассы.",
}
IMPACT_SUMMARIES = {
    "balanced": "сервис оставляет подбор максимально нейтральным и не тянет его отдельно ни в парк, ни во freeride.",
    "switch-freestyle": "сервис чуть сильнее поддерживает более живую подачу доски, комфорт в свиче и быстрое перекантовывание.",
    "groomers-carving": "сервис мягко смещает результат в сторону собранной длины и более направленного ощущения доски на скорости.",
    "soft-snow": "сервис дает больше запаса по длине и поднимает формы, которые спокойнее ведут себя в разбитом и мягком снегу.",
}
#: Value of the length card, and what its description says after the range.
IMPACT_LENGTHS = {
    "balanced": ("без лишнего сдвига", "не смещается дополнительно вверх или вниз: это базовый универсальный подбор без отдельного уклона в парк или мягкий снег."),
    "switch-freestyle": ("чуть короче и живее", "удерживается ближе к нижней части нейтрального сценария: это снижает лишнюю инерцию и делает доску проще в перекантовке."),
    "groomers-carving": ("чуть собраннее", "слегка сдвинут вверх относительно нейтрального варианта на 1 см, чтобы добавить больше опоры в дуге и на скорости."),
    "soft-snow": ("длиннее с запасом", "получил прибавку до 2 см относительно нейтрального сценария, чтобы дать больше опоры и плавучести вне трассы."),
}
IMPACT_SHAPES = {
    "balanced": "Подбор не уходит в крайность и держит форму как универсальный центр. Допустимыми рядом остаются %s, если модель сильна по длине и ширине.",
    "switch-freestyle": "В приоритете формы, которые легче раскрываются в свиче и в более игривом катании. Рядом остаются %s как более универсальные компромиссы.",
    "groomers-carving": "Подбор поднимает выше формы, которые увереннее входят в дугу и спокойнее держат скорость. Альтернативы вроде %s остаются в рабочей зоне, если хочется меньше перекоса.",
    "soft-snow": "Подбор усиливает формы с большим запасом для мягкого снега и разбитого рельефа. Альтернативы вроде %s остаются как более нейтральные варианты.",
}
IMPACT_FEELS = {
    "balanced": ("максимально универсально", "Этот приоритет оставляет самый нейтральный характер: без лишнего уклона ни в игривую, ни в сугубо направленную подачу доски."),
    "switch-freestyle": ("живее под ногами", "Этот приоритет делает акцент на более быстрой перекантовке, понятном свиче и меньшем ощущении тяжелой доски в ногах."),
    "groomers-carving": ("стабильнее в дуге", "Этот приоритет усиливает ощущение собранной доски, которая спокойнее стоит на канте и увереннее ощущается на скорости."),
    "soft-snow": ("спокойнее вне трассы", "Этот приоритет добавляет больше запаса в разбитом и мягком снегу, чтобы доска ощущалась менее нервной вне ровной трассы."),
}
STYLE_NAMES = {"all-mountain": "all-mountain", "park": "park / freestyle", "freeride": "freeride / powder"}
TEMPERS = {"relaxed": "спокойный", "balanced": "сбалансированный", "aggressive": "агрессивный"}
STANCES = {"standard": "стандартная стойка", "duck": "duck stance", "unknown": "не уверен в стойке"}
LINE_NAMES = {"men": "мужская / унисекс", "women": "женская", "any": "не важно"}
SKILL_NAMES = {"beginner": "начинающий", "intermediate": "средний уровень", "advanced": "продвинутый"}
DRAG_NAMES = {"low": "низкий", "medium": "средний", "high": "высокий"}
WIDTH_NAMES = {"regular": "обычная ширина", "mid-wide": "mid-wide", "wide": "wide"}
WIDTH_TEXTS = {
    "regular": "Подходит большинству райдеров со стандартным размером ботинка.",
    "mid-wide": "Нужен запас по ширине, но без перехода в максимально широкую доску.",
    "wide": "Широкая геометрия снижает риск зацепа ботинком при крупных размерах.",
}
SHAPE_TEXTS = {
    "switch-freestyle": ("Сейчас логичнее смотреть в сторону twin или близких к нему форм.", "Приоритет на свич, side hits и более живое ощущение под ногами лучше всего раскрывается на twin. Если хочется оставить чуть больше универсальности, хорошим компромиссом остаётся асимметричный или направленный твин."),
    "groomers-carving": ("Сейчас логичнее смотреть в сторону более направленной формы.", "Если приоритетом являются трасса и дуга, направленная геометрия обычно даёт более собранный вход в поворот и спокойнее держит скорость. Направленный твин остаётся рабочим вариантом, если не хочется совсем терять универсальность."),
    "soft-snow": ("Сейчас логичнее смотреть в сторону направленной формы с запасом для мягкого снега.", "Если хочется больше уверенности в мягком снегу и разбитом рельефе, в приоритете оказываются направленные формы. Тейпер здесь особенно полезен, когда катание заметно смещено в freeride-сценарий."),
    "park": ("Сейчас логичнее смотреть в сторону twin или близких к нему форм.", "Для парка, свича и более игривой подачи безопаснее всего начинать с twin. Если хочется чуть больше универсальности вне парка, подойдёт и направленный твин."),
    "freeride-relaxed": ("Сейчас логичнее смотреть в сторону направленной формы.", "Во freeride-сценарии направленная геометрия обычно даёт больше спокойствия на скорости и понятнее ведёт доску носом вперёд. Тейпер здесь тоже в рабочей зоне."),
    "freeride": ("Сейчас логичнее смотреть в сторону направленной формы с тейпером.", "Если катание смещено в freeride и хочется больше запаса в мягком снегу, tapered directional обычно выглядит сильнее всего. Простая направленная форма тоже остаётся хорошим вариантом."),
    "aggressive": ("Сейчас логичнее смотреть в сторону более направленной формы.", "Для более жёсткого all-mountain катания направленная геометрия часто даёт спокойнее вход в дугу и больше стабильности. Направленный твин остаётся хорошим компромиссом, если не хочется терять универсальность."),
    "balanced": ("Сейчас логичнее смотреть в сторону направленного твина.", "Для универсального катания направленный твин обычно даёт лучший баланс: доска остаётся живой и понятной, но не уходит слишком далеко ни в парк, ни в чистый freeride."),
}
EXPLAIN_TERRAIN = {
    "balanced": "Приоритет выбран как универсальный, поэтому сервис не смещает подбор лишний раз в парк или freeride.",
    "switch-freestyle": "Дополнительный приоритет на свич и freestyle слегка удерживает рекомендацию ближе к более живой стороне диапазона.",
    "groomers-carving": "Дополнительный приоритет на трассу и дугу чуть смещает подбор к более собранной длине и направленной форме.",
    "soft-snow": "Дополнительный приоритет на мягкий снег даёт небольшой сдвиг к длине и форме с большим запасом вне трассы.",
}
EXPLAIN_WEIGHT = "Вес %s кг даёт базовый диапазон %s-%s см. Дальше мы мягко подправили его под рост %s см, стиль %s и ваш %s темп катания."
EXPLAIN_LENGTH = 'Итоговый диапазон %s-%s см остаётся рабочей зоной, но внутри неё сервис дополнительно ищет размер ближе к идеальной точке около %s см, а не просто любую доску "в пределах".'
EXPLAIN_WIDTH = "Размер ботинка EU %s и %s выводят вас в категорию %s. Мы ориентируемся на целевую талию около %s мм и отдельно штрафуем варианты, которые становятся заметно шире нужного. %s"
CARVING_CLEARANCE = " Для carving-сценария мы оставили дополнительный запас по талии, чтобы снизить риск касания ботинком снега на больших углах закантовки."
EXPLAIN_SHAPE = "%s Базовый ориентир здесь — %s. %s"
EXPLAIN_FLEX = "По жёсткости доски сейчас логичнее смотреть в диапазон %s-%s из 10: это помогает не тянуть слишком дубовую модель в relaxed/park-сценарий и не опускаться слишком мягко в aggressive/freeride."
EXPLAIN_DRAG = "Риск boot drag сейчас оценивается как %s. Это не абсолютный приговор, а понятная подсказка: при выборе доски уже видно, где ширина безопасна, а где лучше не рисковать."
EXPLAIN_TRUST = "В подборе мы дополнительно учитываем линию %s и уровень %s, а в выдаче выше ставим проверенные карточки с живыми ссылками, чтобы рекомендации выглядели надёжнее."
# -----------------------------------------------------------------------------------------------------------------


def reason_codes() -> Column:
    """The codes of the first three reasons of a candidate, in order of weight: a bad fit first, then the parts of the score."""
    c = F.col
    near = F.abs(c("size_cm") - c("target"))
    length = F.when(c("length_off") == 0, F.when(near <= 0.75, "length-ideal").when(c("size_cm") < c("target"), "length-lively").otherwise("length-stable")).when(c("length_off") <= 2.5, "length-near")
    shape = F.when(c("shape_type") == c("shape_first"), "shape-first").when(F.array_contains("shape_others", c("shape_type")), "shape-other")
    f, off = c("flex"), F.greatest(c("flex_lo") - c("flex"), c("flex") - c("flex_hi"), F.lit(0))
    soft = F.when(off > 2, "flex-too-soft").when((off > 1) & (c("soft_boost") >= 4), "flex-soft")
    stiff = F.when(off > 2, "flex-too-stiff").when((off > 1) & (c("stiff_boost") >= 4), "flex-stiff")
    flex = F.when(c("flex_trusted"), F.when(off == 0, "flex").when(f < c("flex_lo"), soft).otherwise(stiff))
    slack = F.when(c("stance_type") == "duck", -1.5).otherwise(-1.0)
    over, spare = c("over_width"), c("spare")
    width = F.when((spare >= 0) & (spare <= over), "width").when((spare > over) & (spare <= over + 4), "width-over").when(spare >= slack, F.lit(None)).when(spare >= -3, "width-edge").otherwise("width-risk")
    found = [
        F.when((c("hard") == 1) & (c("mild") >= 1), "compromise"),
        length,
        F.when(c("weight_known") & (c("weight_off") == 0), "weight"),
        F.when(style_points() > 0, "style"),
        shape,
        F.when(skill_points() > 0, "skill"),
        flex,
        F.when(terrain_points() >= 8, "terrain"),
        F.when(F.array_contains("camber_best", c("camber_profile")), "camber"),
        width,
    ]
    return F.slice(F.array_compact(F.array(*found)), 1, 3)


def _text(code: Column, texts: dict[str, str]) -> Column:
    return choose(code, texts, None)


def matches_with_texts(riders: DataFrame, products: DataFrame, sizes: DataFrame) -> DataFrame:
    """The matches of ``recommend`` with fit and confidence labels, the codes of up to three reasons, and their texts."""
    codes = reason_codes()
    out = recommend(riders, products, sizes, {"reason_codes": codes, "shape_type": F.col("shape_type")})
    label = _text(F.col("shape_type"), SHAPES)
    texts = F.transform("reason_codes", lambda x: F.replace(_text(x, REASONS), F.lit("%s"), F.coalesce(label, F.lit(""))))
    return out.withColumn("fit_label", _text(F.col("role"), FITS)).withColumn("confidence_label", _text(F.col("confidence"), CONFIDENCES)).withColumn("reasons", texts).drop("shape_type")


def comparison(riders: DataFrame, products: DataFrame, sizes: DataFrame) -> DataFrame:
    """rider_id, rank, title, size_label, role_label, summary and five highlights of the first three boards of a rider."""
    own = F.col("rider_style")
    also = {n: F.col(n) for n in ("brand", "model_name", "waist_width_mm", "waist", "lo", "hi", "shape_type", "shape_first", "shape_others", "ready")} | {"board_style": F.col("riding_style"), "own_style": own}
    m = recommend(riders, products, sizes, also).where("list = 'recommended' and place <= 3")
    c, has = F.col, F.col("waist_width_mm") - F.col("waist")
    length = F.when(c("size_cm") <= c("lo") + 1, "length-low").when(c("size_cm") >= c("hi") - 1, "length-high").otherwise("length-middle")
    width = F.when(has >= 4, "width-much").when(has >= 1, "width-some").when(has >= 0, "width-exact").otherwise("width-narrow")
    style = F.when(c("board_style") == c("own_style"), "style-same").when(c("board_style") == "all-mountain", "style-universal").when(c("own_style") == "all-mountain", "style-shifted").otherwise("style-compromise")
    shape = F.when(c("shape_type").isNull(), "shape-unknown").when(c("shape_type") == c("shape_first"), "shape-first").when(F.array_contains("shape_others", c("shape_type")), "shape-other").otherwise("shape-off")
    say = lambda code, *values: F.printf(_text(code, HIGHLIGHTS), *values) if values else _text(code, HIGHLIGHTS)
    lines = F.array(
        say(length),
        say(width, c("waist_width_mm").cast("string"), c("waist").cast("string")),
        say(style, _text(c("board_style"), STYLES)),
        F.when(c("shape_type").isNull(), _text(F.lit("shape-unknown"), HIGHLIGHTS)).otherwise(say(shape, F.coalesce(_text(c("shape_type"), SHAPES), F.lit("")))),
        say(F.when(c("ready"), "ready").otherwise("not-ready")),
    )
    return m.select("rider_id", c("place").alias("rank"), F.concat_ws(" ", "brand", "model_name").alias("title"), size_label(c("size_label"), c("size_cm")).alias("size_label"), _text(c("role"), ROLES).alias("role_label"), _text(c("role"), SUMMARIES).alias("summary"), lines.alias("highlights"))


def priority_impact(riders: DataFrame) -> DataFrame:
    """rider_id, headline, summary and the cards (id, value, description) that say what a rider's priority changed."""
    p, terrain = with_profile(riders), F.col("terrain_priority")
    pick = lambda table, i: choose(terrain, {k: v[i] for k, v in table.items()}, table["balanced"][i])
    one = lambda table: choose(terrain, table, table["balanced"])
    span = F.concat(number_text(F.col("lo")), F.lit("-"), number_text(F.col("hi")), F.lit(" см"))
    others = F.array_join(F.transform("shape_others", lambda x: _text(x, SHAPES)), ", ")
    card = lambda name, value, text: F.struct(F.lit(name).alias("id"), value.alias("value"), text.alias("description"))
    cards = F.array(
        card("length", pick(IMPACT_LENGTHS, 0), F.concat(F.lit("Рабочий диапазон "), span, F.lit(" "), pick(IMPACT_LENGTHS, 1))),
        card("shape", _text(F.col("shape_first"), SHAPES), F.replace(one(IMPACT_SHAPES), F.lit("%s"), others)),
        card("feel", pick(IMPACT_FEELS, 0), pick(IMPACT_FEELS, 1)),
    )
    summary = F.concat(F.lit('Вы выбрали сценарий "'), one(TERRAINS), F.lit('", поэтому '), one(IMPACT_SUMMARIES))
    return p.select("rider_id", one(IMPACT_HEADLINES).alias("headline"), summary.alias("summary"), cards.alias("cards"))


def explanation(riders: DataFrame) -> DataFrame:
    """rider_id and lines: the eight texts that explain a rider's result, in order."""
    p, c = with_profile(riders), F.col
    say = lambda template, *values: F.printf(F.lit(template), *values)
    label = lambda name, table: choose(c(name), table, None)
    n = lambda name: number_text(c(name))
    target = F.format_number(F.round("target", 1), 1)
    carving = F.when(c("terrain_priority") == "groomers-carving", CARVING_CLEARANCE).otherwise("")
    lines = F.array(
        say(EXPLAIN_WEIGHT, n("weight_kg"), n("base_lo"), n("base_hi"), n("height_cm"), label("riding_style", STYLE_NAMES), label("aggressiveness", TEMPERS)),
        say(EXPLAIN_LENGTH, n("lo"), n("hi"), target),
        choose(c("terrain_priority"), EXPLAIN_TERRAIN, EXPLAIN_TERRAIN["balanced"]),
        F.concat(say(EXPLAIN_WIDTH, n("boot_size_eu"), label("stance_type", STANCES), label("width_type", WIDTH_NAMES), n("waist"), label("width_type", WIDTH_TEXTS)), carving),
        say(EXPLAIN_SHAPE, _shape_text(0), label("shape_first", SHAPES), _shape_text(1)),
        say(EXPLAIN_FLEX, n("flex_lo"), n("flex_hi")),
        say(EXPLAIN_DRAG, label("boot_drag_risk", DRAG_NAMES)),
        say(EXPLAIN_TRUST, label("board_line_preference", LINE_NAMES), label("skill_level", SKILL_NAMES)),
    )
    return p.select("rider_id", lines.alias("lines"))


def _shape_text(i: int) -> Column:
    """Headline (0) or description (1) of the shapes that suit a rider."""
    terrain, style, temper = F.col("terrain_priority"), F.col("riding_style"), F.col("aggressiveness")
    t = {k: F.lit(v[i]) for k, v in SHAPE_TEXTS.items()}
    by_style = F.when(style == "park", t["park"]).when(style == "freeride", F.when(temper == "relaxed", t["freeride-relaxed"]).otherwise(t["freeride"])).when(temper == "aggressive", t["aggressive"]).otherwise(t["balanced"])
    return F.when(terrain == "switch-freestyle", t["switch-freestyle"]).when(terrain == "groomers-carving", t["groomers-carving"]).when(terrain == "soft-snow", t["soft-snow"]).otherwise(by_style)
