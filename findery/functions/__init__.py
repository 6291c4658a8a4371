"""Column functions: text, web addresses, language and intents."""
