"""Values that results depend on. They must stay as they are."""

# Windows in days, similarity threshold and candidate limits.
NEAR_DAYS = 3
SUPPLIER_DAYS = 45
TEXT_SIMILARITY = 0.35
GROUP_LIMIT = 14
TAX_GROUP_LIMIT = 20
SCORED_LIMIT = 30
MONTH_GROUP_LIMIT = 18
MONTH_FALLBACK_LIMIT = 20

# Words that say nothing about a payee.
IGNORED_TOKENS = ("boleto", "pago", "pix", "pgto", "qr", "code", "transf", "transferencia", "enviada", "recebida", "ltda", "sa", "s", "a", "me", "eireli", "mei", "cpf", "cnpj")

# Words left out when payees are compared for groups.
IGNORED_PAYEE_TOKENS = ("servico", "servicos", "pagamento", "referente")

# Terms of taxes and charges paid through the federal bank.
TAX_TERMS = (
    "darf", "imposto", "impostos", "tributo", "tributos", "irpf", "irpj", "irrf", "imposto renda", "simples", "simples nacional", "das", "fgts", "fundo garantia", "inss", "previdencia", "gps", "pis",
    "cofins", "csll", "ipi", "ipva", "icms", "itcmd", "licenciamento", "multa", "multas", "transito", "iptu", "iss", "issqn", "itbi", "alvara", "coleta lixo", "iluminacao publica", "taxa municipal", "taxas municipais",
)

# Remarks on matches.
NOTE_EQUAL_VALUE = "Conciliado automaticamente porque o tipo e o valor sao iguais."
NOTE_EQUAL_VALUE_ONLY = "Conciliado automaticamente por valor igual; validar demais informacoes."
NOTE_TAX = "Pagamento para CAIXA ECONOMICA associado a tributo/encargo do sistema."
NOTE_NO_LINK = "Sem ligacao textual clara; manter na aba de validacao por valor igual."
NOTE_BRANCH_GROUP = "Agrupamento conciliado por soma exata com CNPJ de mesma raiz e filial diferente entre Banco e Sistema."
NOTE_TAX_GROUP = "Agrupamento de tributo/encargo conciliado com CAIXA ECONOMICA porque a soma dos valores fecha."
NOTE_PAYEE_GROUP = "Agrupamento conciliado por soma exata, data proxima e fornecedor/prestador compativel."
NOTE_SUM = "Conciliado por soma exata de parcelas do Sistema contra um lançamento do Banco."
NOTE_SUM_TAX = "Tributo/encargo associado a CAIXA ECONOMICA; parcelas do Sistema somam exatamente o valor do Banco."
NOTE_DUPLICATE = "Possivel duplicidade: mesmo mes, tipo, valor e documento/texto-base."
NOTE_NEAR = "Mesmo documento/CNPJ raiz e tipo, com data próxima ou mesmo mês, mas valor diferente."

# Text categories and their words.
CATEGORIES = {
    "tecnologia": ("tecnologia", "informatica", "software", "hardware", "computador", "notebook", "impressora", "toner", "sistema", "internet", "digital", "dados", "licenca", "cloud", "nuvem"),
    "papelaria": ("papelaria", "papel", "caneta", "toner", "cartucho", "material", "expediente"),
    "escritorio": ("escritorio", "administrativo", "expediente", "material", "arquivo", "mobiliario", "cadeira", "mesa"),
    "limpeza": ("limpeza", "higiene", "descartavel", "conservacao", "sanitizante"),
    "manutencao": ("manutencao", "reparo", "servico", "peca", "instalacao", "conserto"),
    "transporte": ("transporte", "frete", "entrega", "corrida", "logistica", "combustivel", "gasolina", "diesel"),
    "alimentacao": ("alimentacao", "refeicao", "restaurante", "lanche", "mercado"),
    "saude": ("saude", "hospital", "clinica", "medico", "laboratorio", "medicamento", "exame", "cardiologia"),
    "tributos": ("darf", "imposto", "impostos", "tributo", "tributos", "taxa", "das", "gps", "fgts", "irrf", "irpf", "irpj", "inss", "iss", "issqn", "pis", "cofins", "csll", "ipi", "ipva", "icms", "itcmd", "iptu", "itbi", "alvara"),
    "servicos profissionais": ("contabilidade", "contador", "advogado", "juridico", "consultoria", "honorario"),
}
