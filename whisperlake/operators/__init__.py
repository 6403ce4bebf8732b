"""DataFrame operators over events, contacts, messages, deliveries and files."""
