"""DataFrame to DataFrame operators over events and their satellites."""
