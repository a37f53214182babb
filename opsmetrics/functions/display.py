"""Display projections: report columns renamed to their shown labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# Labels shown for the reports (must equal the reference's text).
ALLOCATION_LABELS = {
    "tipo": "Tipo",
    "operativo": "Operativo",
    "cargas_posibles_adicionales": "Capacidad Disponible",
    "velocidad_promedio_dias": "Velocidad Promedio (días)",
    "eficacia_historica": "Eficacia Histórica (%)",
    "indice_estrategico": "Índice Estratégico",
}
OWNER_PERFORMANCE_LABELS = {
    "duracion_promedio": "Duración Promedio",
    "cerradas": "Nº Op. Cerradas",
    "mas_rapido": "Más Rápido (días)",
    "mas_lento": "Más Lento (días)",
}
CYCLE_LABELS = {
    "tipo": "Tipo",
    "tiempo_estandar": "Tiempo Estándar (días)",
    "meta_mejora": "Meta de Mejora (días)",
    "duracion_real_promedio": "Duración Real Promedio (días)",
}
SESSION_LABELS = {
    "username": "Usuario",
    "session_start": "Inicio de Sesión",
    "session_end": "Fin de Sesión",
    "duration_minutes": "Duración (min)",
}


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Rename the columns present in ``labels`` (metadata only)."""
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})
