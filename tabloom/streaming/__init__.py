"""tabloom.streaming"""
