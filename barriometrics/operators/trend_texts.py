"""Spanish titles, descriptions and values for the trend numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barriometrics import dims
from barriometrics.operators.trends import KEY, level


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(value, 0), 0))


def pct(value: Column, signed: bool = False) -> Column:
    text = F.format_string("%.1f%%", F.abs(F.bround(value, 1)))
    # The sign is the value's own: a small fall prints as -0.0%.
    return F.concat(F.when(value < 0, "-").otherwise("+" if signed else ""), text)


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("s/d")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(name: str) -> Column:
    return F.col(name).cast("int")


def _entries() -> list[tuple[str, str, str, Column, Column]]:
    """(audience, metric_type, title, description, value) over the columns of ``trend_facts``."""
    c = F.col
    band = F.element_at(F.array(*[F.lit(b) for b in dims.SIZE_BANDS]), c("top_band") + 1)
    up = lambda name, yes, no: F.when(c(name) > 0, yes).otherwise(no)
    return [
        ("owner", "price_trend", "Precios de alquiler",
         _text("El alquiler medio pasó de ", money(c("avg_price_old")), " a ", money(c("avg_price_new")), ": los precios ",
               up("price_change", "aumentaron", "disminuyeron"), " ", pct(F.abs("price_change")), "."),
         pct(c("price_change"), True)),
        ("owner", "competition", "Competencia",
         _text("Competencia ", level(c("top_pct"), 40, 25, "alta", "moderada", "baja"), ": ", c("top_n"), " de ", c("n_new"),
               " avisos tienen ", _number("top_rooms"), " ambientes (", pct(c("top_pct")), ")."),
         _text(c("n_new"), " propiedades")),
        ("owner", "price_per_m2", "Valor del m²",
         _text(money(c("price_m2_new")), " por m², ", pct(F.abs("m2_diff")), up("m2_diff", " por encima", " por debajo"),
               " de la ciudad (", money(c("price_m2_city")), ")", F.when(c("m2_diff") > 5, ", zona premium.").otherwise(".")),
         _text(money(c("price_m2_new")), "/m²")),
        ("owner", "market_rotation", "Rotación",
         _text("Rotación ", level(c("rotation_rate"), 30, 15, "rápida", "moderada", "lenta"), ": ", c("new_codes"),
               " altas y ", c("removed_codes"), " bajas desde el informe anterior."),
         _text(pct(c("rotation_rate")), " rotación")),
        ("owner", "top_segment", "Segmento principal",
         _text(_number("top_rooms"), " ambientes reúne ", c("top_n"), " avisos (", pct(c("top_pct")), ") a ", money(c("top_price")),
               F.when(c("top_pct") > 35, ", claramente dominante.").otherwise(".")),
         _text(_number("top_rooms"), " ambientes")),
        ("agent", "market_growth", "Crecimiento de la oferta",
         _text("Mercado ", level(c("growth_rate"), 5, -5, "creciendo", "estable", "contrayéndose"), "; oportunidad ",
               level(F.abs("growth_rate"), 10, 5, "Alta", "Moderada", "Estable"), "."),
         pct(c("growth_rate"), True)),
        ("agent", "price_segmentation", "Precios por segmento",
         _text(_number("top_rooms"), " ambientes lidera con ", c("top_n"), " avisos; diferencia con el segundo segmento ",
               pct(c("price_gap"), True), F.when(F.abs("price_gap") > 15, ", marcada.").otherwise(", acotada.")),
         money(c("top_price"))),
        ("agent", "competitive_position", "Posición frente a otros barrios",
         _text("Barrio ", F.when(c("competitive_position") < -5, "más económico")
               .when(F.abs("competitive_position") <= 5, "similar").otherwise("más premium"),
               ": ", money(c("avg_price_new")), " frente a ", money(c("avg_price_competitors")), "."),
         pct(c("competitive_position"), True)),
        ("agent", "inventory", "Inventario",
         _text(c("inventory_summary"), ". Menos oferta: ", _number("rare_rooms"), " ambientes (", pct(c("rare_pct")), ")",
               F.when(c("rare_pct") < 20, ", un nicho abierto.").otherwise(".")),
         _text(c("n_new"), " unidades")),
        ("agent", "price_per_m2_trend", "Evolución del m²",
         _text("El m² varió ", pct(c("m2_trend"), True), F.when(c("m2_trend") > 2, " (valorización)")
               .when(F.abs("m2_trend") <= 2, " (estable)").otherwise(" (baja)"),
               "; el cuarto más barato promedia ", money(c("best_value_avg")), "/m²."),
         _text(money(c("price_m2_new")), "/m²")),
        ("tenant", "timing", "Momento para alquilar",
         _text("Momento ", F.when(c("price_change") < 0, "favorable").when(c("price_change") > 5, "menos favorable")
               .otherwise("neutral"), ": precio medio ", money(c("avg_price_new")), "."),
         pct(c("price_change"), True)),
        ("tenant", "availability", "Disponibilidad",
         _text("Disponibilidad ", level(c("n_new"), 50, 20, "alta", "moderada", "limitada"), " con ", c("new_codes"),
               " avisos nuevos."),
         _text(c("n_new"), " propiedades")),
        ("tenant", "best_deals", "Mejores precios",
         _text(c("deals"), " avisos hasta ", money(c("price_threshold")), " (", money(c("deals_avg_m2")), "/m²), ",
               pct(c("savings_pct")), " bajo la media", F.when(c("deals") < 10, "; pocos, conviene apurarse.").otherwise(".")),
         money(c("deals_avg_price"))),
        ("tenant", "property_profile", "Perfil de la oferta",
         _text("Predomina ", band, " m²: ", c("top_band_n"), " avisos (", pct(c("top_band_pct")), "), ",
               F.format_string("%.1f", F.bround(c("top_band_rooms"), 1)), " ambientes y ",
               F.format_string("%.1f", F.bround(c("top_band_bathrooms"), 1)), " baños; ", pct(c("premium_pct")), " premium",
               F.when(c("bands_in_use") >= 3, "; oferta variada.").otherwise("; oferta concentrada.")),
         _text(c("top_band_n"), " en segmento principal")),
        ("tenant", "market_speed", "Ritmo del mercado",
         _text("Mercado ", level(c("removal_rate"), 40, 25, "muy dinámico", "dinámico", "pausado"), ": ", c("removed_codes"),
               " avisos retirados; urgencia ", level(c("removal_rate"), 40, 25, "alta", "moderada", "baja"), "."),
         _text(pct(c("removal_rate")), " rotación")),
    ]


def trend_rows(facts: DataFrame) -> DataFrame:
    """Long table: neighbourhood, audience, position, metric_type, title, description, value."""
    rows = [
        F.struct(
            F.lit(audience).alias("audience"), F.lit(i).alias("position"), F.lit(kind).alias("metric_type"),
            _text(title, " en ", F.col(KEY)).alias("title"), description.alias("description"), value.alias("value"),
        )
        for i, (audience, kind, title, description, value) in enumerate(_entries())
    ]
    return facts.select(KEY, F.inline(F.array(*rows)))


def trend_documents(facts: DataFrame, run_date: str) -> DataFrame:
    """One document per neighbourhood with the three audiences' lists of five metrics each."""
    day = F.lit(run_date).cast("date")
    rows = trend_rows(facts)
    entry = F.struct("position", "title", "description", "value", "metric_type")
    lists = rows.groupBy(KEY).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("audience") == who, entry))),
                lambda e: F.struct(e.title.alias("title"), e.description.alias("description"), e.value.alias("value"),
                                   e.metric_type.alias("metric_type")),
            ).alias(f"{who}_trends")
            for who in ("owner", "agent", "tenant")
        ]
    )
    return lists.select(
        KEY, F.date_format(day, "MM_yyyy").alias("date"), F.current_timestamp().alias("generated_at"),
        "owner_trends", "agent_trends", "tenant_trends",
    )
