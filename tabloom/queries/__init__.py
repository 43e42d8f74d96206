"""tabloom.queries"""
