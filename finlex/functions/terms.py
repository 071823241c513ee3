"""Term dictionaries.

FIXED VALUES: the lists below must equal the reference's word lists for the
features to give the same counts.  They are stated plainly, in their natural
order, and are used as small literal dictionaries (no shuffle needed).
"""

from __future__ import annotations

# --- FIXED VALUES: default sentiment lexicon (positive / negative / neutral) ---
DEFAULT_LEXICON: dict[str, list[str]] = {
    "positive": [
        "crescimento", "aumento", "lucro", "positivo", "alta", "valorização",
        "superou", "melhor", "expansão", "superar", "rentabilidade", "benefício",
        "apreciação", "excelente", "eficiência", "sucesso", "oportunidade", "forte",
    ],
    "negative": [
        "queda", "redução", "prejuízo", "negativo", "baixa", "desvalorização",
        "perda", "pior", "contração", "diminuição", "risco", "preocupação",
        "deterioração", "fraco", "abaixo", "ameaça", "dívida", "déficit",
    ],
    "neutral": [
        "estável", "manteve", "constante", "igual", "mesmo", "padrão",
        "esperado", "em linha", "conforme", "similar", "comparável", "manter",
        "previsto", "consistente", "sem alteração", "normal", "regular",
    ],
}

# --- FIXED VALUES: negation, intensifier and diminisher terms ---
NEGATION_TERMS = ["não", "nem", "nenhum", "nenhuma", "nunca", "jamais", "tampouco",
                  "sem", "exceto", "salvo"]
INTENSIFIERS = ["muito", "extremamente", "significativamente", "altamente", "bastante",
                "consideravelmente", "expressivamente", "fortemente", "substancialmente"]
DIMINISHERS = ["pouco", "ligeiramente", "levemente", "um pouco", "parcialmente",
               "relativamente", "moderadamente", "minimamente"]

# --- FIXED VALUES: future / past orientation indicators ---
FUTURE_INDICATORS = ["irá", "deverá", "prevê", "projeta", "espera", "antecipa", "planeja"]
PAST_INDICATORS = ["foi", "registrou", "apresentou", "obteve", "alcançou", "realizou"]

# --- FIXED VALUES: impact terms per level ---
IMPACT_TERMS: dict[str, list[str]] = {
    "high_impact": [
        "significativo", "expressivo", "substancial", "considerável", "relevante",
        "forte", "intenso", "acentuado", "pronunciado", "profundo", "massivo",
        "radical", "drástico", "grande", "enorme", "extraordinário", "excepcional",
    ],
    "medium_impact": [
        "moderado", "mediano", "intermediário", "razoável", "parcial",
        "médio", "regular", "moderadamente", "considerável", "notável",
        "sensível", "importante", "apreciável", "perceptível",
    ],
    "low_impact": [
        "leve", "pequeno", "limitado", "suave", "sutil", "modesto", "ligeiro",
        "tênue", "discreto", "mínimo", "marginal", "menor", "pouco", "reduzido",
        "insignificante", "desprezível", "irrisório",
    ],
}

# --- FIXED VALUES: time-horizon indicators ---
TIME_INDICATORS: dict[str, list[str]] = {
    "short_term": ["imediato", "curto prazo", "semana", "mês", "trimestre", "próximos dias",
                   "atual", "recente", "iminente", "breve"],
    "medium_term": ["médio prazo", "semestre", "próximos meses", "ano corrente", "ano fiscal"],
    "long_term": ["longo prazo", "anos", "década", "futuro", "estratégico", "estrutural",
                  "permanente", "duradouro", "sustentável"],
}

# --- FIXED VALUES: document-type indicators (10 types) ---
TYPE_INDICATORS: dict[str, list[str]] = {
    "relatorio_trimestral": ["relatório trimestral", "resultado trimestral",
                             "demonstrações financeiras", "balanço patrimonial",
                             "trimestre encerrado"],
    "comunicado_mercado": ["comunicado ao mercado", "fato relevante", "aviso aos acionistas",
                           "comunicação", "informa ao mercado"],
    "anuncio_dividendos": ["distribuição de dividendos", "juros sobre capital",
                           "pagamento de dividendos", "proventos", "jcp", "dividendo"],
    "previsao_resultado": ["guidance", "projeção", "estimativa", "perspectiva",
                           "previsão", "outlook", "expectativa"],
    "analise_tecnica": ["análise técnica", "suporte", "resistência", "tendência",
                        "indicadores técnicos", "gráfico"],
    "analise_fundamentalista": ["análise fundamentalista", "valuation", "múltiplos",
                                "fundamentos", "valor intrínseco", "fluxo de caixa descontado"],
    "ipo_oferta": ["oferta pública", "ipo", "emissão de ações", "bookbuilding",
                   "prospecto", "follow-on"],
    "aquisicao_fusao": ["aquisição", "fusão", "incorporação", "combinação de negócios",
                        "compra de participação", "m&a"],
    "reestruturacao": ["reestruturação", "reorganização societária", "cisão", "spin-off",
                       "recuperação judicial", "reestruturação de dívida"],
    "mudanca_gestao": ["novo presidente", "novo ceo", "novo diretor", "mudança na diretoria",
                       "conselho de administração", "eleição de membros"],
}

# --- FIXED VALUES: coarse preprocessing indicators (F1, F2) ---
COARSE_TYPE_INDICATORS: dict[str, list[str]] = {
    "relatorio": ["relatório", "trimestral", "anual", "resultados"],
    "comunicado": ["comunicado", "fato relevante", "mercado"],
    "guidance": ["projeção", "guidance", "previsão", "expectativa"],
}
COARSE_POSITIVE = ["aumento", "crescimento", "lucro", "positivo"]
COARSE_NEGATIVE = ["queda", "redução", "prejuízo", "negativo"]
